"""Small summaries of large stores: Bloom filters of the keys that are done, and distinct counts that grow by increments.

A Bloom filter is a table (block, w0..w3): a key belongs to one block and sets one bit in each of its four words. Filters of one number of blocks merge by OR, so a store's
filter is kept beside it and joined with that of each new batch; no old key is read again. A key whose bits are not all set is certainly new.

Distinct counts are kept as sketches, one row of bytes per table or group, merged per batch; their error is about 1.04 / 2^(lg_k / 2) of the count (one standard
deviation), and small counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
KEYS_PER_BLOCK = 12  # 256 bits: about 21 a key, one false hit in some hundred
FILTER_BYTES = 64 << 20  # a filter is broadcast up to this size
KEYS_PER_TASK = 500_000  # a task of the exact anti join holds about so many keys of the store
LG_K = 14


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_BLOCK))


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit per word, drawn from a second hash."""
    h = F.xxhash64(F.lit(23), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3) of the keys of a table; null keys are in no filter."""
    k = F.col(key)
    placed = df.filter(k.isNotNull()).select(_place(k, blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_bits(k))])
    return merged_filters([placed])


def merged_filters(filters: Sequence[DataFrame]) -> DataFrame:
    """One filter of all keys; the filters have the same number of blocks."""
    every = reduce(DataFrame.unionByName, filters)
    return every.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_bytes(blocks: int) -> int:
    return blocks * 8 * (WORDS + 1)


def maybe_in(df: DataFrame, key: str, found: DataFrame, blocks: int, out: str = "maybe", limit: int = FILTER_BYTES) -> DataFrame:
    """Add whether a row's key may be in the filter; false is certain. Rows meet the filter's blocks, never its store.

    A filter of up to `limit` bytes is broadcast. A larger one is shuffled, and a task holds its share of the blocks and lets the rows pass; no row is sorted.
    """
    k = F.col(key)
    held = found.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    held = F.broadcast(held) if filter_bytes(blocks) <= limit else held.hint("shuffle_hash")
    met = df.withColumn("_block", F.when(k.isNotNull(), _place(k, blocks))).join(held, "_block", "left")
    test = reduce(lambda x, y: x & y, [F.col(f"_w{i}").bitwiseAND(w) != 0 for i, w in enumerate(_bits(k))])
    return met.withColumn(out, F.coalesce(test, F.lit(False))).select(*df.columns, out)


def skip_stored(rows: DataFrame, store: DataFrame, found: DataFrame, blocks: int, key: str = "url", limit: int = FILTER_BYTES) -> DataFrame:
    """Rows whose key is not in the store, exactly, by way of the store's filter.

    Rows that the filter rules out are new and meet the store no more. For the others a filter of their own keys, broadcast up to `limit` bytes, is held
    against the store where it is read, so only keys that may be among them are shuffled for the exact anti join. A task of that join holds its share of
    the store's keys, as many as `blocks` lets expect, and lets the rows pass, however many have one key.
    """
    names = rows.columns
    judged = maybe_in(rows, key, found, blocks, "_maybe", limit)
    doubtful = judged.filter("_maybe").select(names)
    n = doubtful.count()
    asked = blocks_for(n)
    keys = store.select(F.col(key))
    if filter_bytes(asked) <= limit:
        keys = maybe_in(keys, key, bloom_filter(doubtful, key, asked), asked, "_asked", limit).filter("_asked").select(key)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-max(n, blocks * KEYS_PER_BLOCK) // KEYS_PER_TASK))
    # The rows follow the keys' parts; dealt out by hand, they would be dealt a second time, after the join.
    rest = doubtful.join(keys.distinct().repartition(parts, key).hint("shuffle_hash"), key, "left_anti").select(names)
    return judged.filter("not _maybe").select(names).unionByName(rest)


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(by, records, <column>…): the number of rows and a sketch of the distinct values of each column; nulls are no values."""
    # Values count as text, so that columns of any type have a sketch.
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(c) for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *sketches)


def merged_sketches(parts: Sequence[DataFrame], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all parts together; the rows they were made of are not read."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), *[F.hll_union_agg(c).alias(c) for c in columns])


def distinct_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The estimated counts in place of the sketches; no sketch counts nothing."""
    return sketches.withColumns({c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("long") for c in columns})
