"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's bytes; a chunk ends where masked bits of the hash are zero. The mask is strict up to the normal
chunk size and loose beyond it, which keeps sizes near the normal one, between a smallest and a largest size. As the hash looks at the last
16 bytes only, an edit moves the boundaries near it and no others. A fingerprint is the set of chunk digests with each chunk's
length; containment is the length of the chunks found in the other set over the length of all.

Fingerprint strings list `digest:length` in order of digest, 16 hexadecimal digits each, joined by blanks; a text without bytes has an
empty one.

Defined results: a null text is the empty one; equal texts have equal fingerprints; containment of an empty set is 1 in an empty
set and 0 in any other; a chunk that repeats inside a text counts once. For neighbours in id order, rows with equal ids follow the
order of a hash of the text, null ids come last, the last row is followed by the first, and a single row by itself; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import BLOCK, LETTERS, add_columns, arrow_schema, id_cuts, partitions, range_of, span_hashes, text_blocks, without

LEAST, NORMAL, MOST = 16, 48, 256
STRICT, LOOSE = np.uint16(0xFC00), np.uint16(0xF000)
GEAR = (LETTERS >> np.uint64(17)).astype("uint16")

Print = tuple[np.ndarray, np.ndarray]  # digests in order, and the chunks' lengths


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte, over the last 16 bytes (what a 16-bit hash remembers)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts of a block; every text's end is one."""
    h = gear_hashes(data)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = ((h[loose - 1] & STRICT) == 0).tolist()
    loose = loose.tolist()
    ends = []
    put = ends.append
    i, n = 0, len(loose)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while start < stop:
            least, normal, most = start + LEAST, start + NORMAL, min(start + MOST, stop)
            while i < n and loose[i] < least:
                i += 1
            while i < n and loose[i] < normal and not strict[i]:
                i += 1
            start = loose[i] if i < n and loose[i] < most else most
            put(start)
    return np.array(ends, dtype="int64")


def prints(texts: list[bytes]) -> list[Print]:
    """Fingerprints of texts."""
    out: list[Print] = []
    column = pa.array(texts, type=pa.large_binary())
    for low, high, data, offsets in text_blocks(column.cast(pa.large_string(), safe=False)):
        ends = boundaries(data, offsets)
        starts = np.concatenate([[0], ends[:-1]]).astype("int64")
        digests, sizes = span_hashes(data, starts, ends), ends - starts
        cuts = np.searchsorted(ends, offsets, side="right")
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            keys, at = np.unique(digests[a:b], return_index=True)
            out.append((keys, sizes[a:b][at]))
    return out


def as_text(found: Print) -> str:
    return " ".join(f"{d:016x}:{n}" for d, n in zip(found[0].tolist(), found[1].tolist()))


def containment(inner: Print, outer: Print) -> float:
    """Share of the inner set's length that the outer set holds."""
    whole = int(inner[1].sum())
    if not whole:
        return float(len(outer[0]) == 0)
    if not len(outer[0]):
        return 0.0
    at = np.minimum(np.searchsorted(outer[0], inner[0]), len(outer[0]) - 1)
    return float(inner[1][outer[0][at] == inner[0]].sum() / whole)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text."""
    rows = without(docs, [out])
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.StringType())])
    arrow = arrow_schema(schema)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = prints([(t or "").encode() for t in batch.column(text).to_pylist()])
            yield add_columns(batch, [pa.array([as_text(p) for p in found], type=pa.string())], arrow)

    return rows.mapInArrow(add, schema)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


COMPARED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def with_following(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_task: int = 4) -> DataFrame:
    """Rows (part, doc_id, text, tail) whose order inside a part is descending id, each part ended by the row that follows its last.

    Texts are shuffled once: ids are cut into ranges, and the first row of each range is also sent to the range before it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    cuts = id_cuts(rows, "doc_id", per_task * n)
    # Range numbers fall with the id; null ids get the last one.
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - range_of(F.col("doc_id"), cuts))
    dealt = rows.withColumn("part", part)
    # At most a row per range: the id its first row has.
    heads = sorted(dealt.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r["part"])
    if not heads:
        return dealt.withColumn("tail", F.lit(False))
    before = {r["part"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    spark = docs.sparkSession
    table = spark.createDataFrame([(r["part"], r["head"], before[r["part"]]) for r in heads], "part int, head long, previous int")
    found = dealt.join(F.broadcast(table), "part", "left")
    # A null head belongs to the range of null ids, all of whose rows may come first.
    first = F.col("doc_id").eqNullSafe(F.col("head"))
    places = F.when(first, F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("previous").alias("part"), F.lit(True).alias("tail")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("tail")))
    )
    each = found.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.tail")
    return each.repartition(n, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document, by descending id."""
    arrow = arrow_schema(COMPARED)

    def result(group: list[tuple[int, str]]) -> pa.RecordBatch:
        """All rows of the group but the last, which only follows."""
        texts = [t for _, t in group]
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = prints([t.encode() for t in texts])
        raw = [t.encode() for t in new]
        other = prints(raw)
        k = len(new)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in group[:k]], type=pa.int64()), pa.array([len(t) for t in texts[:k]], type=pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw], type=pa.string()),
            pa.array([as_text(p) for p in own[:k]], type=pa.string()), pa.array([as_text(p) for p in other], type=pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, other)], type=pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, own[1:])], type=pa.float64()),
        ], schema=arrow)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, part, ended = [], 0, None, False
        for batch in batches:
            ids, texts, parts, tails = (batch.column(i).to_pylist() for i in range(4))
            for i, t, p, tail in zip(ids, texts, parts, tails):
                if p != part:
                    group, size, part, ended = [], 0, p, False
                if ended:
                    continue  # more rows that share the following row's id
                group.append((i, t))
                size += len(t)
                ended = tail
                if tail or size >= BLOCK:
                    if len(group) > 1:
                        yield result(group)
                    # The last row opens the next group, as its own follower is still to come.
                    group, size = group[-1:], len(group[-1][1])

    return with_following(docs, doc_id, text).mapInArrow(walk, COMPARED)
