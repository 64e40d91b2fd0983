"""Registry of the driver queries and the SQL fragments they are checked with."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.functions.common import SPACE, texts
from qaforge.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, so that both engines report the same types."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query with its SQL twin, if it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# Tables whose rows carry enough work to be worth spreading when they come in fewer splits than there are cores.
HEAVY = {"documents", "pages", "conversations", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


# ---------------------------------------------------------------- SQL fragments

WS = f"[{SPACE}]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values: Sequence[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def strip_sql(x: str, chars: str = SPACE) -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def clean_sql(x: str) -> str:
    out = f"regexp_replace({x}, '[¶Â]|<\\[\\d+\\]', '', 'g')"
    out = f"regexp_replace({out}, '{WS}+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\[[^\\]\\n]*\\]', ' ', 'g')"
    return strip_sql(out)


def sentences_sql(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.?!]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def any_sql(x: str, cues: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(c)})" for c in cues) + ")"


def hits_sql(x: str, cues: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(c)})::INT" for c in cues) + ")"


def first_sql(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(x, v)} THEN {lit(k)}" for k, v in rules.items()) + f" ELSE {default} END"


def best_sql(scores: dict[str, str], default: str) -> str:
    """Highest score, first label on ties; scores are column names."""
    names = list(scores.values())
    top = f"greatest({', '.join(names)})"
    cases = " ".join(f"WHEN {s} = {top} THEN {lit(k)}" for k, s in scores.items())
    return f"CASE WHEN {top} <= 0 THEN {default} {cases} END"


def lookup_sql(x: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def keywords_sql(x: str) -> str:
    bare = f"list_transform({words_sql(f'lower({x})')}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    return f"list_filter({bare}, lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+'))"


def distinct_sql(x: str) -> str:
    """Distinct list entries in order; `x` is a column name."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


# ---------------------------------------------------------------- shared inputs

PAIRS_CTE = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, r.answer
  FROM conversations u
  JOIN (SELECT conv_id, turn - 1 AS turn, min(text) AS answer FROM conversations WHERE role = 'assistant' GROUP BY ALL) r
    ON u.conv_id = r.conv_id AND u.turn = r.turn
  WHERE u.role = 'user')"""

DOC_QA_CTE = """qa AS (
  SELECT doc_id AS pos, source AS site, regexp_extract(text, '^[^\\n]*') AS question,
         substr(text, length(regexp_extract(text, '^[^\\n]*')) + 2) AS answer
  FROM documents)"""


def doc_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pairs: first line and the rest; (pos, site, question, answer)."""
    q = F.regexp_extract("text", r"^[^\n]*", 0)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.col("source").alias("site"), q.alias("question"),
        F.substr(F.col("text"), F.length(q) + 2).alias("answer"),
    )


def cue(id_col: Column, cues: Sequence[str], step: int = 1) -> Column:
    """A list entry drawn by row number."""
    return F.element_at(texts(list(cues)), (F.pmod(id_col * step, F.lit(len(cues))) + 1).cast("int"))


def cue_sql(id_col: str, cues: Sequence[str], step: int = 1) -> str:
    return f"{arr(list(cues))}[CAST(({id_col} * {step}) % {len(cues)} + 1 AS INT)]"


def prompts(spark: SparkSession, sf_dir: str, cues: Sequence[str]) -> DataFrame:
    """(id, n, text): every document followed by two cue words, and a short prompt per event."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("n"),
        F.concat_ws(" ", "text", cue(F.col("doc_id"), cues), cue(F.col("doc_id"), cues, 7)).alias("text"),
    )
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_id").alias("n"),
        F.concat_ws(" ", "event_type", cue(F.col("event_id"), cues, 3), cue(F.col("event_id"), cues, 5), F.col("props")).alias("text"),
    )
    return docs.unionByName(events)


def prompts_cte(cues: Sequence[str]) -> str:
    return f"""prompts AS (
  SELECT 'd' || doc_id AS id, doc_id AS n, text || ' ' || {cue_sql('doc_id', cues)} || ' ' || {cue_sql('doc_id', cues, 7)} AS text FROM documents
  UNION ALL
  SELECT 'e' || event_id AS id, event_id AS n, event_type || ' ' || {cue_sql('event_id', cues, 3)} || ' ' || {cue_sql('event_id', cues, 5)} || ' ' || props AS text FROM events)"""
