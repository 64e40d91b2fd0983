"""Texts are looked through once: no pattern per blank, no cleaning for a filter and again for the result."""

import random
import re

from pyspark.sql import functions as F

from qaforge.functions import text as T
from qaforge.functions.common import SPACE, UNEVEN, WS, strip
from qaforge.plans.site_corpus import clean_pairs, site_corpus


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_character_is_white_space_as_before(spark):
    rows = spark.range(1, 0x11000).filter("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    old, new = F.col("c").rlike(f"[{SPACE}]"), F.col("c").rlike(WS)
    assert rows.filter(old != new).count() == 0 and rows.filter(new).count() == 29
    assert rows.filter(strip(F.concat("c", F.lit("x"), "c")) != F.regexp_replace(F.concat("c", F.lit("x"), "c"), f"^[{SPACE}]+|[{SPACE}]+$", "")).count() == 0


def test_strip_and_squeeze_match_their_patterns(spark):
    pick = random.Random(3)
    texts = ["", " ", "\t", "　 \x85", None] + ["".join(pick.choice(" \t\n  \x1cabé中") for _ in range(pick.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(
        strip(F.col("t")).alias("a"), F.regexp_replace("t", f"^[{SPACE}]+|[{SPACE}]+$", "").alias("b"),
        F.regexp_replace("t", UNEVEN, " ").alias("c"), F.regexp_replace("t", f"[{SPACE}]+", " ").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in both.collect())
    # The pattern tried each run of blanks once per blank.
    assert "regexp" not in plan(df.select(strip(F.col("t"))))


def test_pairs_are_cleaned_once(spark):
    """The plan held the patterns once for the filter on the length and once more for the result."""
    pairs = spark.createDataFrame([(1, 0, 0, " What  is it? ", "It is so. It's that. It is so. Why not? No.")], "page_id int, rule_ord int, pos int, question string, answer string")
    got = clean_pairs(pairs)
    assert got.columns == pairs.columns
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0, "What is it?", "It is so. It is that.")]
    kept = got.filter(F.length("answer") >= 5)
    filters = [line for line in plan(kept).split("\n") if re.match(r"[ :+-]*Filter ", line)]
    assert filters and not [f for f in filters if "regexp_replace" in f or "replace(" in f]
    pages = spark.createDataFrame([(1, "http://a/faq", "<h3>What is it?</h3><p>It is a thing that does much.</p>")], "page_id int, url string, html string")
    assert {r.answer for r in site_corpus(pages).collect()} == {"It is a thing that does much."}


def test_contractions_are_searched_in_one_copy_of_the_text(spark):
    df = spark.createDataFrame([("it's  so",), ("none",), (None,)], "t string")
    out = df.select(T.expand_contractions(F.regexp_replace("t", " +", " ")).alias("o"))
    assert [r.o for r in out.collect()] == ["it is so", "none", None]
    assert plan(out).count("regexp_replace") == 1
