"""Keyed row diffs by counts against plain pairing, and diffs of key ranges against diffs of whole tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from qaforge.operators import tablediff as TD


def report(df):
    return Counter((r.issue, r.column_or_pk, r.details) for r in df.collect())


def plain(a, b, names, own):
    """Report rows of two lists of tuples whose first field is the key, by counting; leftovers of a key pair up one to one."""
    left, right = defaultdict(Counter), defaultdict(Counter)
    for rows, side in ((a, left), (b, right)):
        for r in rows:
            side[r[0]][r] += 1
    missing, differs, gone = Counter(), 0, 0
    for k in set(left) | set(right):
        l, r = left[k], right[k]
        both = sum((l & r).values())
        nl, nr = sum(l.values()) - both, sum(r.values()) - both
        differs += min(nl, nr)
        missing[k, "Row missing in db2"] += max(nl - nr, 0)
        missing[k, "Row missing in db1"] += max(nr - nl, 0)
    return differs, +missing


@pytest.mark.parametrize("seed", range(4))
def test_pairs_by_counts(spark, seed, monkeypatch):
    monkeypatch.setattr("qaforge.operators.ranking.MAX_GROUP", 3)
    r = random.Random(seed)

    def rows(n):
        return [(r.choice([None, 1, 2, 3, 4]), r.choice(["a", "b", None]), r.choice([0.5, 1.0, None])) for _ in range(n)]

    a = rows(60)
    b = a[:40] + rows(25)
    ddl = "k int, s string, x double"
    got = TD.diff_rows(spark.createDataFrame(a, ddl).repartition(3), spark.createDataFrame(b, ddl).repartition(2), "t", ["k"]).collect()
    differs, missing = plain(a, b, ["s", "x"], [])
    assert sum(r.issue == "Content differs" for r in got) == differs
    assert Counter((None if r.column_or_pk == "" else int(r.column_or_pk), r.issue) for r in got if r.issue != "Content differs") == missing


def test_columns_of_one_side(spark):
    a = spark.createDataFrame([(1, "x", "p"), (1, "x", "q"), (1, "x", None), (2, "y", None), (3, "z", "r")], "k int, s string, own string")
    b = spark.createDataFrame([(1, "x", 9), (1, "x", 8), (2, "y", 7), (3, "w", 6)], "k int, s string, other int")
    got = report(TD.diff_rows(a, b, "t", ["k"]))
    # Two of the three rows of key 1 have a partner; whichever they are, what they alone hold is told.
    told = [x for x in got.elements() if x[1] == "1"]
    assert len([x for x in told if x[0] == "Row missing in db2"]) == 1 and all(x[2] in ("own: p -> None", "own: q -> None", "") for x in told)
    assert [x for x in got.elements() if x[1] != "1"] == [("Content differs", "3", "s: z -> w; own: r -> None")]
    unique = report(TD.diff_rows(a.filter("k > 1"), b.filter("k > 1"), "t", ["k"]))
    assert unique == Counter([("Content differs", "3", "s: z -> w; own: r -> None")])


def test_a_row_held_very_often(spark):
    many = spark.range(400_000).select(F.lit(7).alias("k"), F.lit("same").alias("s"))
    extra = many.unionAll(many.limit(3))
    got = TD.diff_rows(many, extra, "t", ["k"])
    assert report(got) == Counter({("Row missing in db1", "7", ""): 3})
    assert TD.diff_rows(many, many, "t", ["k"]).count() == 0


@pytest.mark.parametrize("key", ["k", "name"])
def test_changed_ranges(spark, key):
    base = spark.range(50_000, numPartitions=4).select((F.col("id") * 3 - 1000).alias("k"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 17).alias("v"))
    base = base.unionAll(base.filter("k % 1000 = 1")).unionAll(spark.createDataFrame([(None, None, 5)], "k long, name string, v long"))
    other = base.filter("k is null or k <> 200").withColumn("v", F.when(F.col("k").isin(5, 90_002), F.lit(99)).otherwise(F.col("v"))).unionAll(spark.createDataFrame([(None, None, 6), (10**6, "new", 1)], "k long, name string, v long"))
    l, r = TD.changed_rows(base, other, [key], levels=(64, 16))
    assert 0 < l.count() < 2500 and r.count() < 2500
    whole = report(TD.diff_rows(base, other, "t", [key]))
    assert whole and report(TD.diff_changed_rows(base, other, "t", [key], levels=(64, 16))) == whole
    same = TD.changed_rows(base, base.repartition(7), [key])
    assert same[0].count() == same[1].count() == 0
    assert TD.diff_changed_rows(base.limit(0), base.limit(0), "t", [key]).count() == 0
    assert TD.diff_changed_rows(base.limit(0), base, "t", [key]).count() == base.count()


def test_equal_tables_shuffle_no_rows(spark, tmp_path):
    """What is exchanged is a row of sums per range and task, and unchanged files of an ordered table are not read again."""
    spark.range(200_000, numPartitions=8).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v")).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.withColumn("v", F.when(F.col("k") == 777, F.lit("x")).otherwise(F.col("v")))
    l, _ = TD.changed_rows(a, b, ["k"])
    assert l.count() == 1
    plan = l._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "GreaterThanOrEqual(k,777)" in plan
