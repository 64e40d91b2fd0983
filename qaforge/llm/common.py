"""Helpers shared by the corpus operators: scratch tables, id ranges, and vectorised work on text bytes.

Texts are handled inside tasks as one byte array per block of rows with an offset per row. A null text counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.session import checkpoint_dir

# Bytes of text that one vectorised step works on; a longer text is a step of its own.
BLOCK = 1 << 20


# ---------------------------------------------------------------- tables


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs neither redo its work nor need its executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop input columns whose names the operator is about to use (names compare without case, as Spark does)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def find(rows: DataFrame, on: str, table: DataFrame, weight: str, limit: int) -> DataFrame:
    """Inner join with a table of distinct keys; its rows of more than `limit` in weight, a bounded number, are broadcast.

    The weight of a key is at least the number of rows that have it, so no key brings more than `limit` rows to the shuffled part.
    """
    hot = F.broadcast(table.filter(F.col(weight) > limit))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(table.filter(F.col(weight) <= limit), on))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def id_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most `parts - 1` values that cut the rows into ranges of about equal row counts (reads the key column only)."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(F.col(key), shares, 100 * parts).alias("c")).first()["c"]
    return sorted(set(got or []))


def range_of(key: Column, cuts: Sequence[int]) -> Column:
    """Number of the range a key lies in; null keys lie in range 0. Only the key column goes to Python."""
    at = np.array(cuts, dtype="int64")

    @F.pandas_udf(T.IntegerType())
    def find(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = np.zeros(len(keys), dtype="int32")
        if len(at):
            out[known] = np.searchsorted(at, keys[known].astype("int64"), side="right")
        return pd.Series(out)

    return find(key)


# ---------------------------------------------------------------- bytes in tasks


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of an Arrow string column: (first row, row after the last, bytes, offset of each row and end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype="int64")[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype="uint8") if data is not None and data.size else np.zeros(0, dtype="uint8")
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letters = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype="uint64") | np.uint64(1)
    lower = np.arange(256, dtype="uint8")
    lower[65:91] += 32
    return letters, lower


LETTERS, LOWER = _tables()
BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n at least (kept for the usual block size)."""
    size = BLOCK + 1 if n <= BLOCK else n
    if size not in _powers:
        _powers.clear() if size > BLOCK + 1 else None
        both = []
        for step in (BASE, _INVERSE):
            a = np.full(size, step, dtype="uint64")
            a[0] = 1
            both.append(np.cumprod(a, dtype="uint64"))
        if size > BLOCK + 1:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of each byte span [start, end); equal bytes give equal digests wherever they stand."""
    up, down = _power_arrays(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype="uint64")
    sums[0] = 0
    np.cumsum(LETTERS[data] * up[: len(data)], dtype="uint64", out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype("uint64") * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which the 256-entry table `inside` is true: (starts, ends, row of each); runs end with their row."""
    on = inside[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = on.copy()
    begin[1:] &= ~on[:-1] | edge[1:n]
    end = on.copy()
    end[:-1] &= ~on[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def byte_table(outside: Sequence[tuple[int, int]]) -> np.ndarray:
    """Table that is false for the given byte ranges (both ends included)."""
    table = np.ones(256, dtype=bool)
    for a, b in outside:
        table[a : b + 1] = False
    return table


# Words as runs of anything but the space and the control characters 9 to 13.
BLANK_WORDS = byte_table([(0x20, 0x20), (0x09, 0x0D)])
# Words as runs of ASCII letters and digits and of any character beyond ASCII (after lower-casing A-Z).
PLAIN_WORDS = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """Digest of each `size` consecutive values; the result is `size - 1` shorter."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype="uint64")
    h = values[:n].copy()
    for j in range(1, size):
        h *= np.uint64(0xA0761D6478BD642F)
        h += values[j : n + j]
    return mix(h + np.uint64(size))


def add_columns(batch: pa.RecordBatch, arrays: Sequence[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """The batch's columns followed by new ones, under the given schema."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def isin_sorted(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted value in a sorted array, or -1."""
    if not len(sorted_values):
        return np.full(len(wanted), -1, dtype="int64")
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)
