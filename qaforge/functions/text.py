"""Text cleaning as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions.common import SPACE, UNEVEN, WS, has_any, let, lines, strip, texts, words
from qaforge.rules import lexicons as R

_QUESTION_STARTS = "|".join(s.replace(r"\s", WS) for s in R.QUESTION_STARTS)
_NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
_NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"
# A question word, later a question mark on the same line.
QUESTION_IN_SENTENCE = (
    f"(?i){_NOT_WORD_BEFORE}(?:{'|'.join(R.QUESTION_WORDS)}){_NOT_WORD_AFTER}[^\\n]*\\?"
)


def clean_text(col: Column) -> Column:
    """Drop stray marks and reference brackets, squeeze white space."""
    out = F.regexp_replace(col, "[¶Â]|<\\[\\d+\\]", "")
    out = F.regexp_replace(out, UNEVEN, " ")
    # Only plain spaces are left as white space here.
    return F.trim(F.regexp_replace(out, r"\[[^\]\n]*\]", " "))


def clean_text_numbered(
    col: Column, contractions: Sequence[tuple[str, str]] | None = None, compat: bool = False
) -> Column:
    """clean_text plus numbering removal, contraction expansion and sentence dedupe.

    `compat` also strips a bare leading "q", which turns "Question" into "uestion".
    """
    out = F.regexp_replace(col, "[¶Â]|<\\[\\d+\\]", "")
    out = F.regexp_replace(out, UNEVEN, " ")
    if compat:
        out = F.regexp_replace(out, r"(?i)^q[ .:;\-)]*\d*\.? *", "")
    else:
        out = F.regexp_replace(out, r"(?i)^q(?:[ .:;\-)]+\d*|\d+)\.? *", "")
    out = F.regexp_replace(out, r"^\d+\. *", "")
    out = F.regexp_replace(out, r" +\d+\. *$", "")
    out = F.regexp_replace(F.trim(out), r"\[[^\]\n]*\]", " ")
    if contractions:
        out = expand_contractions(out, contractions)
    return strip(dedupe_sentences(out))


def sentences(col: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark followed by white space."""
    return F.split(col, f"(?<=[.?!]){WS}+")


def dedupe_sentences(col: Column) -> Column:
    """Keep the first copy of every sentence, in order."""
    return F.array_join(F.array_distinct(sentences(col)), " ")


def ascii_fold(col: Column) -> Column:
    """Drop every character outside ASCII."""
    return F.regexp_replace(col, r"[^\x00-\x7F]+", "")


def expand_contractions(col: Column, rules: Sequence[tuple[str, str]] = tuple(R.CONTRACTIONS)) -> Column:
    """Apply literal replacements one after the other."""
    table = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in rules])

    def expanded(text: Column) -> Column:
        replaced = F.aggregate(table, text, lambda acc, r: F.replace(acc, r["f"], r["t"]))
        # Most texts hold none of the left-hand sides; one scan settles that.
        return F.when(has_any(text, _shortest_cover(rules)), replaced).otherwise(text)

    return let(col, expanded)


def _shortest_cover(rules: Sequence[tuple[str, str]]) -> list[str]:
    """Fewest left-hand sides that occur in all others, so one of them must occur if any rule applies."""
    froms = sorted({a for a, _ in rules}, key=len)
    keep: list[str] = []
    for f in froms:
        if not any(k in f for k in keep):
            keep.append(f)
    return keep


def _is_question(s: Column) -> Column:
    # Most sentences have no such mark; one short scan settles that.
    return F.contains(s, F.lit("?")) & s.rlike(QUESTION_IN_SENTENCE)


def cut_answer(answer: Column, question: Column) -> Column:
    """Sentences before the first one that is a question or repeats the question."""

    def cut(bound: Column) -> Column:
        parts, q = bound["s"], bound["q"]
        stop = F.array_position(
            F.transform(parts, lambda s: _is_question(s) | F.contains(F.lower(s), q)), F.lit(True)
        )
        kept = F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts)
        return strip(F.array_join(kept, " "))

    bound = F.struct(sentences(answer).alias("s"), F.lower(question).alias("q"))
    return F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(let(bound, cut))


def cut_answer_v2(answer: Column, question: Column, min_len: int = 10) -> Column:
    """Like cut_answer, but skips sentences that repeat the question and blanks answers that are too short."""

    def cut(bound: Column) -> Column:
        parts, q = bound["s"], bound["q"]
        stop = F.array_position(F.transform(parts, _is_question), F.lit(True))
        kept = F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts)
        kept = F.filter(kept, lambda s: ~F.contains(F.lower(s), q))
        text = strip(F.array_join(kept, " "))
        return F.when((F.length(text) < min_len) | (F.lower(text) == q), "").otherwise(text)

    body = F.regexp_replace(answer, f"(?i)^{WS}*(?:A:|Answer:){WS}*", "")
    bound = F.struct(sentences(body).alias("s"), F.lower(question).alias("q"))
    return F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(let(bound, cut))


def looks_like_question(col: Column) -> Column:
    """Ends with a question mark, or opens with a question word or a Q-number."""
    pattern = rf"(?i)^(?:q[.\-:)]*{WS}*\d*{WS}*|{_QUESTION_STARTS})\b"
    return let(strip(col), lambda t: (t != "") & (t.endswith("?") | t.rlike(pattern)))


def strip_qa_prefix(col: Column, prefix: str = "Q:") -> Column:
    """Remove a literal marker wherever it stands, then trim."""
    return strip(F.replace(col, F.lit(prefix), F.lit("")))


def min_length(df: DataFrame, q: str = "question", a: str = "answer", q_min: int = 5, a_min: int = 5) -> DataFrame:
    """Pairs whose question and answer have at least this many characters."""
    return df.filter((F.length(q) >= q_min) & (F.length(a) >= a_min))


def collapse_redundant(col: Column) -> Column:
    """Merge the lines of a paragraph that open with the same three or more words.

    A paragraph qualifies if it has three lines or more, no bullets, and every line has three words or more.
    """

    def shared(a: Column, b: Column) -> Column:
        gap = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
        return F.when(gap == 0, a).otherwise(F.slice(a, F.lit(1), (gap - 1).cast("int")))

    def merged(rows: Column, word_lists: Column, prefix: Column) -> Column:
        n = F.size(prefix)

        def tail(w: Column) -> Column:
            left = F.when(F.size(w) > n, F.slice(w, n + 1, F.size(w) - n)).otherwise(texts([]))
            return strip(F.array_join(left, " "), " ,.;")

        tails = F.filter(F.transform(word_lists, tail), lambda s: s != "")

        def sentence(found: Column) -> Column:
            keys = F.transform(found, F.lower)
            once = F.filter(found, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1)
            text = F.concat_ws(" ", F.array_join(prefix, " "), F.array_join(once, ", "))
            text = F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
            return F.when(F.size(found) == 0, F.array_join(rows, " ")).otherwise(text)

        return let(tails, sentence)

    def paragraph(raw: Column) -> Column:
        rows = F.filter(F.transform(lines(raw), strip), lambda s: s != "")

        def decide(bound: Column) -> Column:
            rs, ws = bound["r"], bound["w"]
            prefix = F.aggregate(ws, F.element_at(ws, 1), shared)
            fits = (
                (F.size(rs) >= 3)
                & ~F.exists(rs, lambda s: s.rlike(r"^[-*•]"))
                & ~F.exists(ws, lambda w: F.size(w) < 3)
            )
            return F.when(
                fits, let(prefix, lambda p: F.when(F.size(p) < 3, raw).otherwise(merged(rs, ws, p)))
            ).otherwise(raw)

        return let(
            rows,
            lambda rs: let(
                F.struct(
                    rs.alias("r"),
                    F.transform(rs, lambda s: words(F.regexp_replace(s, r"[.?!]+$", ""))).alias("w"),
                ),
                decide,
            ),
        )

    joined = F.array_join(F.transform(F.split(col, "\n\n"), paragraph), "\n\n")
    return F.when(F.contains(col, F.lit("\n")), joined).otherwise(col)


def strip_echo(response: Column, question: Column, phrases: Sequence[str] = tuple(R.LEAKED_PHRASES)) -> Column:
    """Drop a leading copy of the question and every line with a leaked instruction."""
    text = strip(F.coalesce(response, F.lit("")))
    asked = strip(F.coalesce(question, F.lit("")))

    def body(b: Column) -> Column:
        t, q = b["t"], b["q"]
        rest = F.regexp_replace(F.substr(t, F.length(q) + 1), r"^[\n: \-]+", "")
        return let(
            F.when((q != "") & t.startswith(q), rest).otherwise(t),
            lambda u: let(
                strip(F.array_join(F.filter(lines(u), lambda s: ~has_any(s, list(phrases))), "\n")),
                lambda kept: F.when(kept == "", u).otherwise(kept),
            ),
        )

    return let(F.struct(text.alias("t"), asked.alias("q")), body)


def text_lengths(df: DataFrame, col: str = "text") -> DataFrame:
    """Words by single-space split, and characters."""
    return df.withColumn("n_words", F.size(F.split(F.col(col), " "))).withColumn("n_characters", F.length(col))


def csv_safe_parens(col: Column) -> Column:
    """Commas inside parentheses become semicolons."""
    return F.regexp_replace(col, r",(?=[^()]*\))", ";")


__all__ = [
    "SPACE", "ascii_fold", "clean_text", "clean_text_numbered", "collapse_redundant", "csv_safe_parens",
    "cut_answer", "cut_answer_v2", "dedupe_sentences", "expand_contractions", "looks_like_question", "min_length",
    "sentences", "strip_echo", "strip_qa_prefix", "text_lengths",
]
