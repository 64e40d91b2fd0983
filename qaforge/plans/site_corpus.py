"""Stored pages to a clean, de-duplicated pair corpus, and on to labelled training records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions import text as T
from qaforge.operators import dedupe as D
from qaforge.operators import extract as X
from qaforge.operators.dom import page_dom
from qaforge.rules.lexicons import CONTRACTIONS
from qaforge.operators.prompts import system_prompt_for_pair, to_chat_records


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Replace columns so that later filters on them do not compute them again: a filter is not moved below a generator."""
    row = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, row).select(*[F.col("_once")[c].alias(c) if c in columns else c for c in df.columns])


def clean_pairs(
    pairs: DataFrame, keys: Sequence[str] = ("question",), order: Sequence[str] = ("rule_ord", "pos"), scope: Sequence[str] = ()
) -> DataFrame:
    """Clean both sides, drop short pairs, keep the first per key and cut answers at the next question.

    `keys` are compared in lower case; `scope` limits the comparison, e.g. to a page.
    """
    clean = _once(pairs, {c: T.clean_text_numbered(F.col(c), CONTRACTIONS) for c in ("question", "answer")})
    long_enough = T.min_length(clean, q_min=5, a_min=5)
    key: list[Column] = [F.col(c) for c in scope] + [F.lower(F.col(c)) for c in keys]
    first = D.first_per_key(long_enough, key, [F.col(c) for c in order])
    return _once(first, {"answer": T.cut_answer(F.col("answer"), F.col("question"))})


def site_corpus(
    pages: DataFrame, mode: str = "union", rules: Sequence[str] = tuple(X.SITE_RULES), keys: Sequence[str] = ("question",),
    min_answer: int = 20, prefilter: bool = False,
) -> DataFrame:
    """(page_id, url, rule, pos, question, answer, context) of all pages, one row per question and site run.

    Pages are read once: the address and context are settled before the parse, then all rules run on the same row.
    """
    source = X.page_prefilter(pages) if prefilter else pages
    tagged = source.withColumn("context", L.page_context_first(F.col("url"), F.col("html")))
    pairs = X.extract_qa(page_dom(tagged), mode, rules)
    corpus = clean_pairs(pairs, keys, ("page_id", "rule_ord", "pos"))
    return corpus.filter(F.length("answer") >= min_answer).drop("rule_ord")


def training_set(corpus: DataFrame, version: str = "best", min_answer: int = 20) -> DataFrame:
    """Add a system prompt of its own to each pair, and the chat record."""
    prompted = system_prompt_for_pair(corpus, context="context", version=version)
    return to_chat_records(prompted, F.col("system_prompt"), min_len=min_answer)


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): every user turn with the assistant turn after it.

    The reply is found by turn number, so a conversation of any length is joined piecewise. A reply stored more than
    once gives its smallest text.
    """
    replies = (
        turns.filter("role = 'assistant'")
        .groupBy("conv_id", (F.col("turn") - 1).alias("turn"))
        .agg(F.min("text").alias("answer"))
    )
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return asked.join(replies, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer")
