"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaforge.session import cut_lineage

# Largest group that one task may sort. Beyond it the group is sorted by many tasks.
MAX_GROUP = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; counts are combined before the shuffle."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def row_number_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn", max_group: int = MAX_GROUP
) -> DataFrame:
    """Number the rows of each group by `order`.

    Groups up to `max_group` rows take one window. If any is larger, rows are range-partitioned on keys and order
    together, so a hot group spans many tasks: each task numbers its own part, and the part sizes before it are
    added as an offset.
    """
    if largest_group(df, keys) <= max_group:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The part number must not move between the jobs below, so it is written down first.
    parts = cut_lineage(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    same = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["_part"] == offsets["_part"]]
    joined = local.join(offsets, same)
    return joined.select(*[local[c] for c in df.columns], (F.col("_rn") + F.col("_offset")).cast("long").alias(out))
