"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 values have it. Two fingerprints link at a small
Hamming distance. With the bits cut into segments, linked fingerprints differ by at most `distance // segments` bits in some
segment, so each fingerprint looks up the small Hamming ball around each of its segments, and the complete distance is verified
inside the join.

Copies share a fingerprint and meet once. Before the lookup, crowded buckets are joined up by a few leaders each: members
within the distance of a leader are linked to it, in one linear pass. The lookup then returns only links between fingerprints
that are not joined already, so a large group of near copies gives no square number of pairs; what it finds and what the leaders
found has the same connected components as all links together.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words than a shingle count as one
shingle; repeated rows share a fingerprint; rows with a null id take the component of their fingerprint and never name it; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import add_columns, arrow_schema, find, without, written

SHINGLE, DISTANCE, SEED = 4, 4, 42
SEGMENTS = 3
LEADERS = 8
SHARE = 1000  # a fingerprint or root with more than one in so many rows is hot
STEP = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype="int64")
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        a, b = starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist()
        values = np.array([digest(line[i:j], seed) for i, j in zip(a, b)], dtype="<u8")
        ones += np.unpackbits(values.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """Add the fingerprint as a 64-bit integer (its bits, read as signed)."""
    rows = without(docs, [out])
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.LongType())])
    arrow = arrow_schema(schema)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(text)), dtype="uint64", count=batch.num_rows)
            yield add_columns(batch, [pa.array(found.view("int64"))], arrow)

    return rows.mapInArrow(add, schema)


def segments_of(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of segments that cover 64 bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _piece(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fp: Column, parts: int) -> list[Column]:
    """A key per segment: the segment's number above its value."""
    return [_piece(fp, low, bits) + F.lit(i << 40) for i, (low, bits) in enumerate(segments_of(parts))]


def _ball(parts: int, radius: int) -> list[list[int]]:
    """Per segment the bit patterns of at most `radius` bits."""
    out = []
    for _, bits in segments_of(parts):
        masks = {0}
        for _ in range(radius):
            masks |= {m ^ (1 << b) for m in masks for b in range(bits)}
        out.append(sorted(masks))
    return out


def near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def leader_links(fps: DataFrame, distance: int = DISTANCE, leaders: int = LEADERS) -> DataFrame:
    """Links (u, v) between distinct fingerprints and the leaders of the buckets they share; linear in the rows."""
    keyed = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), distance + 1))).alias("key"))
    picks = [F.min(F.struct(F.xxhash64("fp", F.lit(i)), F.col("fp")))["fp"] for i in range(leaders)]
    heads = written(keyed.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("heads"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "heads")
    links = keyed.join(heads, "key").select("fp", F.explode(F.filter("heads", lambda h: near(h, F.col("fp"), distance) & (h != F.col("fp")))).alias("head"))
    return links.select(F.greatest("fp", "head").alias("u"), F.least("fp", "head").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): root is the smallest node reachable. Alternates large and small stars until nothing changes."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def _labelled(fps: DataFrame, roots: DataFrame) -> DataFrame:
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def ball_links(labelled: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (u, v) between roots of fingerprints within the distance whose roots differ: all of them, by lookup of Hamming balls."""
    balls = _ball(segments, distance // segments)

    def around(key: Column, masks: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: key.bitwiseXOR(m))

    probes = [around(key, masks) for key, masks in zip(_keys(F.col("fp"), segments), balls)]
    asked = labelled.select(F.col("fp").alias("a"), F.col("root").alias("u"), F.explode(F.concat(*probes)).alias("key"))
    table = labelled.select(F.col("fp").alias("b"), F.col("root").alias("v"), F.explode(F.array(*_keys(F.col("fp"), segments))).alias("key"))
    met = (asked["key"] == table["key"]) & (F.col("a") < F.col("b")) & (F.col("u") != F.col("v")) & near(F.col("a"), F.col("b"), distance)
    return asked.join(table, met).select("u", "v")


def classes(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, leaders: int = LEADERS) -> DataFrame:
    """Distinct fingerprints -> (fp, root), root being the smallest fingerprint of the component."""
    first = written(_labelled(fps, components(leader_links(fps, distance, leaders))), "first")
    joined = components(ball_links(first, distance, segments)).withColumnRenamed("root", "top")
    # A root may stand for a large part of all fingerprints: such roots meet them by broadcast.
    sizes = first.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    tops = written(sizes.join(joined, sizes["root"] == joined["node"], "left").select("root", F.coalesce("top", "root").alias("top"), "n"), "tops")
    return find(first, "root", tops, "n", first.count() // SHARE).select("fp", F.col("top").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links."""
    prints = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "prints")
    smallest = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "smallest")
    roots = written(classes(smallest.select("fp"), distance, segments), "roots")
    members = written(smallest.join(roots, "fp"), "members")
    named = written(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "named")
    size = members.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    ids = written(find(members, "root", named, "n", size["fps"] // SHARE).select("fp", "component_id", "copies"), "ids")
    return find(prints, "fp", ids, "copies", size["rows"] // SHARE).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The document with the smallest id of each group; of rows that repeat that id, one. Rows with a null id stay."""
    found = near_duplicates(docs, doc_id, text, distance, segments)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    one = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    named = docs.join(kept, docs[doc_id] == kept["__kept"]).withColumn("__n", one).filter("__n = 1").select(*[docs[c] for c in docs.columns])
    return named.unionByName(docs.filter(F.col(doc_id).isNull()))
