"""Labels from a table of keywords that is itself drawn from the documents: the words of first lines, labelled by the source they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaforge.operators import rulebook as RB
from qaforge.queries.base import query, table

# Words of six letters and more of the first lines; a rule set per language, a label per source, sources in order of their first document.
_RULES = """words AS (SELECT DISTINCT lang AS rule_set, source AS label, unnest(string_split(lower(regexp_extract(text, '^[^\\n]*')), ' ')) AS keyword FROM documents),
    ords AS (SELECT lang AS rule_set, source AS label, min(doc_id) AS ord FROM documents GROUP BY ALL),
    rules AS (SELECT w.rule_set, ord, w.label, keyword FROM words w JOIN ords o ON w.rule_set = o.rule_set AND w.label = o.label WHERE length(keyword) >= 6),
    low AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
    found AS (SELECT conv_id, turn, rule_set, label, min(ord) AS ord, count(*) AS n, sum((length(t) - length(replace(t, keyword, ''))) // length(keyword)) AS times
      FROM low JOIN rules ON contains(t, keyword) GROUP BY ALL)"""


def _rules(docs):
    first = F.split(F.lower(F.regexp_extract("text", r"^[^\n]*", 0)), " ")
    words = docs.select(F.col("lang").alias("rule_set"), F.col("source").alias("label"), F.explode(first).alias("keyword")).filter(F.length("keyword") >= 6).distinct()
    ords = docs.groupBy(F.col("lang").alias("rule_set"), F.col("source").alias("label")).agg(F.min("doc_id").alias("ord"))
    return words.join(ords, ["rule_set", "label"])


def _labelled(spark, d, mode, limit=RB.BLOCK_BYTES):
    book = RB.compile_rules(_rules(table(spark, d, "documents")), limit)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = RB.label_by_rules(turns, book, mode=mode)
    sets = dict.fromkeys(s for s, _ in book.labels)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("rule_set"), F.col(f"`{s}`").alias("label")) for s in sets]))
    return rows.select("conv_id", "turn", each.alias("e")).select("conv_id", "turn", "e.rule_set", "e.label").filter("label is not null")


@query("rules_best", f"WITH {_RULES} SELECT conv_id, turn, rule_set, label FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn, rule_set ORDER BY n DESC, ord, label) = 1")
def rules_best(spark, d):
    return _labelled(spark, d, "best")


@query("rules_first", f"WITH {_RULES} SELECT conv_id, turn, rule_set, label FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn, rule_set ORDER BY ord, label) = 1")
def rules_first(spark, d):
    return _labelled(spark, d, "first")


@query("rules_counted", f"WITH {_RULES} SELECT conv_id, turn, rule_set, label FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn, rule_set ORDER BY times DESC, ord, label) = 1")
def rules_counted(spark, d):
    return _labelled(spark, d, "counted")


@query("rules_all", f"WITH {_RULES} SELECT conv_id, turn, rule_set, string_agg(label, ',' ORDER BY ord, label) AS label FROM found GROUP BY ALL")
def rules_all(spark, d):
    return _labelled(spark, d, "all").filter(F.size("label") > 0).withColumn("label", F.array_join("label", ","))
