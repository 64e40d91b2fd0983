"""Shards of near-equal byte size for indivisible groups, by Karmarkar-Karp differencing.

Copies of one text form a group that stays together. A partial partition is a vector of shard sizes. The two partial
partitions with the largest spread are combined again and again, the larger shards of one with the smaller of the other.
Groups are counted before they move; each bucket of groups is differenced in a task of its own, and the buckets' vectors are
differenced in the same way, level by level, until one is left. No level holds more than `fan` vectors in one task.

Defined results: a null text counts as the empty one; sizes are bytes plus one; a group larger than an even share stays whole; equal rows each get a slot of their own; an
empty table gives an empty result; input columns named like an output column are replaced; order among equal ids is by checksum and size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaforge.llm.common import partitions, written

FAN = 4096  # vectors that one task may combine


def difference(vectors: Sequence[tuple]) -> tuple[list[int], list[list[int]]]:
    """Combine vectors of equal length: (sizes of the result, for each vector the result's place of each of its places)."""
    if not vectors:
        return [], []
    width = len(vectors[0])
    # A node is its sorted sizes and, behind each place, the vectors' places that ended there, as a linked pair.
    heap = []
    for i, v in enumerate(vectors):
        order = sorted(range(width), key=lambda s: (v[s], s))
        sizes = [v[s] for s in order]
        heap.append((sizes[0] - sizes[-1], i, sizes, [(i, s) for s in order]))
    heapq.heapify(heap)
    tie = len(vectors)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = [(a[s] + b[width - 1 - s], s) for s in range(width)]
        sums.sort()
        sizes = [x for x, _ in sums]
        members = [(in_a[s], in_b[width - 1 - s], None) for _, s in sums]
        heapq.heappush(heap, (sizes[0] - sizes[-1], tie, sizes, members))
        tie += 1
    _, _, sizes, members = heap[0]
    places = [[0] * width for _ in vectors]
    for place, root in enumerate(members):
        stack = [root]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += node[:2]
            else:
                places[node[0]][node[1]] = place
    return sizes, places


def _level(groups: DataFrame, width: int, buckets: int) -> DataFrame:
    """Difference the vectors of each bucket: (id, bucket, places, and on one row of the bucket its sizes)."""

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        sizes, places = difference([tuple(v) for v in rows["sizes"]])
        first = [sizes] + [None] * (len(rows) - 1)
        return pd.DataFrame({"id": rows["id"], "bucket": [str(key[0])] * len(rows), "places": places, "total": first})

    bucket = F.pmod(F.xxhash64("id", F.lit(width)), F.lit(buckets))
    return groups.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        combine, "id string, bucket string, places array<int>, total array<long>"
    )


def assign_groups(groups: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """(id string, size long) with distinct ids -> (id, shard int)."""
    spark = groups.sparkSession
    zeros = F.array_repeat(F.lit(0).cast("long"), shards - 1)
    vectors = groups.select("id", F.concat(zeros, F.array(F.col("size").cast("long"))).alias("sizes"))
    count = groups.count()
    levels = []
    while True:
        # All tasks get a share while there is more than one bucket to make.
        buckets = 1 if count <= 1 or (levels and count <= fan) else max(partitions(spark), -(-count // fan))
        done = written(_level(vectors, shards, buckets), "level")
        levels.append(done)
        if buckets == 1:
            break
        vectors = written(done.filter("total is not null").select(F.col("bucket").alias("id"), F.col("total").alias("sizes")), "vectors")
        count = vectors.count()
    places = levels[-1].select("id", "places")
    for lower in reversed(levels[:-1]):
        upper = places.select(F.col("id").alias("bucket"), F.col("places").alias("upper"))
        moved = F.transform("places", lambda p: F.get("upper", p))
        places = lower.join(upper, "bucket").select("id", moved.alias("places"))
    return places.select("id", F.get("places", F.lit(shards - 1)).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); slots are gapless from 0 in each shard, by id."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = written(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("id"),
        ),
        "slim",
    )
    groups = written(slim.groupBy("id").agg(F.sum("size").alias("size")), "groups")
    placed = slim.join(assign_groups(groups, shards, fan), "id")
    # Slots: rows are dealt over many parts, numbered inside each, and shifted by what the parts before hold.
    parts = partitions(docs.sparkSession)
    dealt = written(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "id"), F.lit(parts)).cast("int")), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    # The offsets have a row per shard and part: shards x shuffle partitions at most.
    numbered = dealt.withColumn("rn", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
