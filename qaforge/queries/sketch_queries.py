"""Skipping what a large store holds, and statistics that grow by increments, each from a store kept in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qaforge.operators import sketches as S
from qaforge.queries.base import query, table
from qaforge.session import checkpoint_dir


def _kept(spark, parts, name):
    """Each part written by itself, as batches are, and read back."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.write.parquet(f"{at}/batch{i}")
    return [spark.read.parquet(f"{at}/batch{i}") for i in range(len(parts))]


@query("skip_stored", "SELECT l_orderkey AS k, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def skip_stored(spark, d):
    """Lines of orders that are not in the store of every third order; its filter was written in two batches."""
    store = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    blocks = S.blocks_for(store.count())
    parts = _kept(spark, [S.bloom_filter(store.filter(f"k % 2 = {i}"), "k", blocks) for i in (0, 1)], "filter")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return S.skip_stored(rows, store, S.merged_filters(parts), blocks, "k")


@query(
    "distinct_sketches",
    """SELECT o_orderpriority AS priority, count(*) AS records, count(DISTINCT o_orderstatus) AS statuses, true AS customers_near, true AS orders_near FROM orders GROUP BY 1""",
)
def distinct_sketches(spark, d):
    """Counts merged from sketches of three batches; those of large columns are within 3 % of the exact ones."""
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority")
    columns = ["o_orderstatus", "o_custkey", "o_orderkey"]
    parts = _kept(spark, [S.distinct_sketches(orders.filter(f"o_orderkey % 3 = {i}"), columns, ["priority"]) for i in range(3)], "sketches")
    merged = S.distinct_counts(S.merged_sketches(parts, columns, ["priority"]), columns)
    exact = orders.groupBy("priority").agg(F.count_distinct("o_custkey").alias("c"), F.count_distinct("o_orderkey").alias("o"))
    near = [(F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b)).alias(name) for a, b, name in (("o_custkey", "c", "customers_near"), ("o_orderkey", "o", "orders_near"))]
    return merged.join(exact, "priority").select("priority", "records", F.col("o_orderstatus").alias("statuses"), *near)
