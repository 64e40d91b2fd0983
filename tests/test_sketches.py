"""Bloom filters and distinct sketches."""

import re

import pytest
from pyspark.sql import functions as F

from qaforge.operators import sketches as S


def test_filter_has_no_false_absence_and_few_false_hits(spark):
    store = spark.range(30_000).select(F.concat(F.lit("http://x/"), "id").alias("url"))
    blocks = S.blocks_for(30_000)
    parts = [S.bloom_filter(store.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == i), "url", blocks) for i in range(3)]
    whole = S.merged_filters(parts)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, S.bloom_filter(store, "url", blocks).collect()))
    asked = spark.range(60_000).select(F.concat(F.lit("http://x/"), "id").alias("url"))
    judged = S.maybe_in(asked, "url", whole, blocks)
    known = F.expr("cast(substr(url, 10) as long) < 30000")
    assert judged.filter(known & ~F.col("maybe")).count() == 0
    assert judged.filter(~known & F.col("maybe")).count() < 600


def test_skip_is_exact(spark):
    store = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("c", 2), (None, 3), ("b", 4), ("d", 5)], "url string, _maybe int")
    for blocks in (1, 50):
        for limit in (S.FILTER_BYTES, 0):
            got = S.skip_stored(rows.withColumnRenamed("_maybe", "n"), store, S.bloom_filter(store, "url", blocks), blocks, limit=limit)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("c", 2), ("c", 2), ("d", 5), (None, 3)]))
    empty = store.limit(0)
    assert S.skip_stored(rows.withColumnRenamed("_maybe", "n"), empty, S.bloom_filter(empty, "url", 1), 1).count() == 6


def test_store_is_not_shuffled_for_other_keys(spark):
    """With a full block per key nearly all of the store is ruled out where it is read."""
    store = spark.range(100_000).select(F.col("id").alias("url"))
    rows = spark.createDataFrame([(5,), (200_000,)], "url long")
    blocks = S.blocks_for(100_000)
    doubtful = S.maybe_in(rows, "url", S.bloom_filter(store, "url", blocks), blocks).filter("maybe")
    asked = S.blocks_for(1)
    passed = S.maybe_in(store, "url", S.bloom_filter(doubtful, "url", asked), asked).filter("maybe").count()
    assert passed < 20
    assert [r.url for r in S.skip_stored(rows, store, S.bloom_filter(store, "url", blocks), blocks).collect()] == [200_000]


@pytest.mark.parametrize("limit", [S.FILTER_BYTES, 0])
def test_no_row_is_sorted_to_meet_filter_or_store(spark, monkeypatch, limit):
    """A task holds its share of the filter and of the store's keys, and lets the rows pass, also when one key has most of them."""
    monkeypatch.setattr(S, "KEYS_PER_TASK", 1_000, raising=False)
    n = 30_000
    store = spark.range(n).selectExpr("'k' || if(id < 20000, id, 7) AS url").unionByName(spark.sql("SELECT cast(null AS string) AS url"))
    rows = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 'k5' WHEN id % 3 = 1 THEN 'new' WHEN id % 100 > 0 THEN 'k' || (id + 10000) END AS url", "id")
    kept = "url = 'new' OR url IS NULL OR cast(substr(url, 2) AS long) >= 20000"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = S.blocks_for(n)
        got = S.skip_stored(rows, store, S.bloom_filter(store, "url", blocks), blocks, limit=limit)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.filter(kept).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    # Both sides of the anti join come in parts of so many keys; a filter up to the limit moves no row.
    assert len(re.findall(r"hashpartitioning\(url#\d+, 30\)", plan)) == 2
    assert ("hashpartitioning(_block" in plan) == (limit == 0)


def test_sketches_merge(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40_000).alias("x"), F.when(F.col("id") % 2 == 0, F.lit("even")).alias("y"))
    parts = [S.distinct_sketches(df.filter(f"x % 4 = {i}"), ["x", "y"], ["g"]) for i in range(4)]
    got = {r.g: r for r in S.distinct_counts(S.merged_sketches(parts, ["x", "y"], ["g"]), ["x", "y"]).collect()}
    exact = {r.g: r for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()}
    for g, e in exact.items():
        assert got[g].records == e.records and got[g].y == e.y == 1 and abs(got[g].x - e.x) <= 0.03 * e.x
    none = S.distinct_counts(S.merged_sketches([S.distinct_sketches(df.limit(0), ["x"])], ["x"]), ["x"]).collect()
    assert [(r.records, r.x) for r in none] == [(0, 0)]
