"""Labels from keyword tables of any size: one automaton over all keywords, one pass over each text.

The fixed lists of `functions.labels` are unrolled into expressions; that ends at some hundred keywords. Here the rules are a table
`rules(rule_set, ord, label, keyword)`, and several rule sets are judged at once. The keywords are compiled into an Aho-Corasick automaton, which finds all of them in
the time of reading the text. The table is cut into blocks of at most `limit` bytes of keywords; each block is sent out once and adds what it finds to the rows, so
no task holds more than one block's automaton. A table that fits one block, as most do, takes one pass and no shuffle.

Defined results: keywords and texts are lower-cased; a keyword counts once for a label however often the table lists it; rules without a keyword, set or label match nothing; a
null text has no hits; ties go to the smaller `ord`, then to the label's name; a label listed with several `ord` takes the smallest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qaforge.session import cut_lineage

BLOCK_BYTES = 16 << 20  # keywords and their entries in one automaton
ENTRY_BYTES, LABEL_BYTES = 64, 8  # what a keyword takes besides its text, and each of its labels
RULES = "rule_set string, ord int, label string, keyword string"

FOUND = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("hits", T.IntegerType())]))


@dataclass(frozen=True)
class RuleBook:
    """`labels`: (rule_set, label) by number, in order of preference within a set; `blocks`: tables of keywords with their label numbers."""

    labels: list[tuple[str, str]]
    blocks: list[list[tuple[str, list[int]]]] = field(repr=False)


def rule_table(spark: SparkSession, sets: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Rule sets given as ordered lists of keywords per label."""
    rows = [(name, i, label, word) for name, rules in sets.items() for i, (label, words) in enumerate(rules.items()) for word in words]
    return spark.createDataFrame(rows, RULES)


def compile_rules(rules: DataFrame, limit: int = BLOCK_BYTES, most: int = 64) -> RuleBook:
    """Number the labels and cut the keywords into blocks; a table of more than `most` blocks is refused."""
    known = rules.select("rule_set", "label", F.col("ord").cast("long").alias("ord"), F.lower("keyword").alias("keyword")).filter(
        "rule_set is not null and label is not null and keyword <> ''")
    words = cut_lineage(known.groupBy("rule_set", "label", "keyword").agg(F.min("ord").alias("ord")))
    # A keyword is sent once with the numbers of its labels, however many rows of the table have it.
    room = F.octet_length("keyword") + ENTRY_BYTES + LABEL_BYTES * F.col("n")
    size = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(room), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > limit * most:
        raise ValueError(f"{size} bytes of rules do not fit {most} blocks of {limit}: raise either, or divide the rule sets")
    ranks = {(r["rule_set"], r["label"]): r["ord"] for r in words.groupBy("rule_set", "label").agg(F.min("ord").alias("ord")).collect()}
    labels = sorted(ranks, key=lambda x: (x[0], ranks[x] is None, ranks[x] or 0, x[1]))
    numbers = rules.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(labels)], "rule_set string, label string, number int")
    entries = words.join(F.broadcast(numbers), ["rule_set", "label"]).groupBy("keyword").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    blocks, block, held = [], [], 0
    for r in entries.orderBy("keyword").toLocalIterator():  # `size` bytes, checked
        block.append((r["keyword"], r["numbers"]))
        held += len(r["keyword"].encode()) + ENTRY_BYTES + LABEL_BYTES * len(r["numbers"])
        if held >= limit:
            blocks.append(block)
            block, held = [], 0
    return RuleBook(labels, [*blocks, block] if block else blocks)


def automaton(block: Iterable[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    """Automaton whose entries are (keyword's number, its length, its label numbers)."""
    found = ahocorasick.Automaton()
    for i, (word, labels) in enumerate(block):
        found.add_word(word, (i, len(word), labels))
    found.make_automaton()
    return found


def hits_in(text: str | None, words: ahocorasick.Automaton, counted: bool) -> dict[int, int]:
    """Keywords that occur in the text per label number; `counted`: their occurrences, those of one keyword without overlap."""
    out: dict[int, int] = {}
    last: dict[int, int] = {}
    for end, (i, size, labels) in words.iter(text or ""):
        if i in last and (not counted or end - size < last[i]):
            continue
        last[i] = end
        for label in labels:
            out[label] = out.get(label, 0) + 1
    return out


def keyword_hits(df: DataFrame, book: RuleBook, text: str = "text", counted: bool = False, out: str = "hits") -> DataFrame:
    """Add an array of (n: label number, hits) of the labels with a hit, by number."""
    rows = df.drop(out)
    if not book.blocks:
        return rows.withColumn(out, F.array().cast(FOUND))
    for i, block in enumerate(book.blocks):
        # One block at a time: what it found is written down before the next one is sent out.
        rows = _add_hits(cut_lineage(rows) if i else rows, block, text, counted, out)
    return rows


def _add_hits(rows: DataFrame, block: list[tuple[str, list[int]]], text: str, counted: bool, out: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in rows.columns if c != out]
    given = rows.select(*[f"`{c}`" for c in kept], (F.col(out) if out in rows.columns else F.array().cast(FOUND)).alias("_was"), F.lower(F.col(f"`{text}`")).alias("_low"))
    schema = T.StructType([*given.schema.fields[:-2], T.StructField(out, FOUND)])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(sent.value)
        for batch in batches:
            found = []
            for before, low in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                all_hits = hits_in(low, words, counted)
                for x in before:
                    all_hits[x["n"]] = all_hits.get(x["n"], 0) + x["hits"]
                found.append([{"n": n, "hits": all_hits[n]} for n in sorted(all_hits)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, type=arrow.field(len(kept)).type)], schema=arrow)

    return given.mapInArrow(find, schema)


def _of_set(book: RuleBook, name: str, hits: Column) -> tuple[Column, int]:
    """Hits of one set, and the number of its first label."""
    mine = [i for i, (s, _) in enumerate(book.labels) if s == name]
    return F.filter(hits, lambda h: (h["n"] >= mine[0]) & (h["n"] <= mine[-1])), mine[0]


def _names(hits: Column, labels: Column, first: int) -> Column:
    return F.transform(hits, lambda h: F.get(labels, h["n"] - first))


def label_by_rules(
    df: DataFrame, book: RuleBook, text: str = "text", mode: str = "best", defaults: Mapping[str, str] | None = None, out: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add a column per rule set (named like it, or as `out` says).

    `best`: the label with most keywords in the text; `counted`: with most occurrences; `first`: the first label with any keyword; `all`: an array of those with any, in
    order. Without a hit: the set's default, else null (`all`: an empty array).
    """
    if mode not in ("best", "counted", "first", "all"):
        raise ValueError(f"unknown mode: {mode}")
    rows = keyword_hits(df, book, text, mode == "counted", "_hits")
    columns = {}
    for name in dict.fromkeys(s for s, _ in book.labels):
        mine, first = _of_set(book, name, F.col("_hits"))
        labels = F.lit([label for s, label in book.labels if s == name])

        if mode == "all":
            columns[(out or {}).get(name, name)] = _names(mine, labels, first)
            continue
        if mode == "first":
            number = F.array_min(F.transform(mine, lambda h: h["n"]))
        else:
            number = -F.array_max(F.transform(mine, lambda h: F.struct(h["hits"].alias("h"), (-h["n"]).alias("n"))))["n"]
        columns[(out or {}).get(name, name)] = F.coalesce(F.get(labels, number - first), F.lit((defaults or {}).get(name)))
    return rows.withColumns(columns).drop("_hits") if columns else rows.drop("_hits")
