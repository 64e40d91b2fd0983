"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the mixed corpus over its share now. A document's copies are
drawn by inverting the Poisson distribution of that mean at a point fixed by a hash of seed, id and text, so a re-run task draws
the same. Copies are made by exploding and dealt over all tasks by a hash of id, text, copy and the row's number in the input, so that neither rows
without an id nor copies of one row come together. A table read from files gives its rows the same numbers again.

Defined results: sources without a weight, and null sources, keep a rate of 1 unless a default is given; a weight of 0 drops
the source; a null text is an empty one and has size 1; equal rows draw equal counts; an empty table gives an empty result; input
columns named `rate`, `copies` or `copy` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.llm.common import partitions, without, written

PIECE = 64.0  # a larger rate is drawn as the sum of equal smaller ones, as exp(-rate) would vanish
RATES_ROWS, RATES_BYTES = 100_000, 8 << 20  # a larger rate table is joined by shuffle


def unit(seed: int, *columns: Column) -> Column:
    """A point in [0, 1) fixed by the seed and the columns (52 bits of an md5)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(2**52))


def _invert(point: Column, rate: Column) -> Column:
    """Smallest k whose cumulated probability passes the point, by summing the probabilities from 0 on.

    rate + 12 roots of it + 24 steps reach beyond the last value that a 52-bit point can give.
    """
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 24).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        more = acc["sum"] <= point
        return F.struct(p.alias("p"), F.when(more, acc["sum"] + p).otherwise(acc["sum"]).alias("sum"), F.when(more, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def poisson_count(seed: int, rate: Column, *key: Column) -> Column:
    """A Poisson count of the given mean, fixed by the seed and the key columns."""
    pieces = F.sequence(F.lit(1), F.greatest(F.ceil(rate / PIECE), F.lit(1)).cast("int"))
    # The point reads the whole text, so it is bound before the steps and not computed at each.
    points = F.transform(pieces, lambda i: unit(seed, i, *key))
    count = F.aggregate(points, F.lit(0), lambda total, point: total + _invert(point, rate / F.size(pieces)))
    return F.when(rate > 0, count).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text", total: float = 1.0) -> DataFrame:
    """(source, bytes, rate): weights are (source, weight); none means equal shares. `total` scales the mixed corpus to the input."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("bytes"))
    known = sizes.filter("source is not null")
    held = known.withColumn("weight", F.lit(1.0)) if weights is None else known.join(weights.select("source", F.col("weight").cast("double")), "source")
    sums = held.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") / (F.col("bytes") / F.col("all_bytes"))
    return held.join(F.broadcast(sums), F.lit(True)).select("source", "bytes", (share * total).alias("rate"))


def replicate(
    docs: DataFrame, rates: DataFrame, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text", default_rate: float = 1.0,
) -> DataFrame:
    """Every document as often as drawn, in an order dealt anew over all tasks; adds `rate`, `copies` and `copy` (from 1)."""
    rows = without(docs, ["rate", "copies", "copy"]).withColumn("__row", F.monotonically_increasing_id())
    rate = written(rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), "rates")
    held = rate.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__source")), F.lit(0))).first()
    if held[0] <= RATES_ROWS and held[1] <= RATES_BYTES:
        rate = F.broadcast(rate)
    drawn = rows.join(rate, rows[source] == rate["__source"], "left").withColumn("rate", F.coalesce("__rate", F.lit(float(default_rate))))
    drawn = drawn.withColumn("__md5", F.md5(F.coalesce(F.col(text), F.lit(""))))
    count = poisson_count(seed, F.col("rate"), F.col(doc_id), F.col("__md5"))
    drawn = drawn.drop("__source", "__rate").withColumn("copies", count)
    each = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = partitions(docs.sparkSession)
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col("__md5"), F.col("__row"), F.col("copy"))
    return each.withColumn("__key", key).drop("__row", "__md5").repartition(n, "__key").sortWithinPartitions("__key").drop("__key")
