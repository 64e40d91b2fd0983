"""Approximate nearest questions: an index of cells, built once and stored, of which a search reads the nearest few.

Vectors are cut into cells around centroids (k-means by cosine, fitted on a bounded sample). Every row of the corpus is stored with its cell, cell after cell,
and cells of many rows are cut into pieces. A search scores the rows of each query's `probes` nearest cells exactly and keeps the best; with all cells
probed the result is that of `top_k`. The number of probes that reaches the wanted recall is measured when the index is built, on sampled rows that look
for their true neighbours.

A null vector, like one of zeros, scores 0 with all others. Ties go to the smaller id; an empty corpus has no cells and finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaforge.operators.retrieval import BROADCAST_QUERIES, Best, _best, _matrix, top_k

SAMPLE = 131_072  # rows that the centroids are fitted on, at most
TRIALS = 256  # sampled rows that measure the recall
MAX_CELLS, CENTROID_BYTES = 4096, 64 << 20  # what is broadcast: at most so many centroids, in so many bytes
PIECE_ROWS = 65_536  # rows of a cell (and queries of a cell) that one task scores at once

_HITS = "query_id long, item_id long, score double"


@dataclass(frozen=True)
class NearestIndex:
    """A stored index: `path/rows` (cell, piece, item_id, v), `path/centroids` (cell, v), `path/about`."""

    path: str
    dim: int
    rows: int
    probes: int
    centroids: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most `rows` rows, those of the smallest hashes of the key; tasks pass on little more than that together."""
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 31)))
    if total > rows:
        hashed = hashed.filter(F.col("_h") < int(min(1.0, 1.1 * rows / total + 1000 / total) * (1 << 31)))
    return hashed.orderBy("_h", key).limit(rows).drop("_h")


def _vectors(df: DataFrame, id_col: str, vec: str, name: str, dim: int | None = None) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias(name), (v if dim is None else F.coalesce(v, F.array_repeat(F.lit(0.0), dim))).alias("v"))


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each vector, nearest first."""
    scores = vectors @ centroids.T
    if n < scores.shape[1]:
        part = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable")
        return np.take_along_axis(part, order, axis=1)
    return np.argsort(-scores, axis=1, kind="stable")


def build_index(
    corpus: DataFrame, path: str, item_id: str = "item_id", vec: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 10,
    sample: int = SAMPLE, seed: int = 1,
) -> NearestIndex:
    """Fit the centroids, store every row under its cell, and measure how many cells a search has to probe.

    Without a number, about the square root of the rows is taken as the number of cells, up to `MAX_CELLS` and a 32nd of the sample.
    """
    spark = corpus.sparkSession
    size = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
    n, dim = size["n"], max(size["dim"] or 0, 0)
    rows = _vectors(corpus, item_id, vec, "item_id", dim)
    at_most = min(MAX_CELLS, max(1, CENTROID_BYTES // max(8 * dim, 1)))
    wanted = min(cells or max(1, min(round(n**0.5), min(n, sample) // 32)), at_most)
    centroids = _fit(rows, wanted, sample, n, seed) if n and dim else np.zeros((0, dim))
    spark.createDataFrame(pd.DataFrame({"cell": range(len(centroids)), "v": centroids.tolist()}), "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _store(rows, centroids, path, n)
    index = NearestIndex(path, dim, n, len(centroids), centroids)
    probes = _calibrate(index, rows, recall, k, n) if n else 0
    about = [(dim, n, probes)]
    spark.createDataFrame(about, "dim int, n long, probes int").coalesce(1).write.parquet(f"{path}/about")
    return NearestIndex(path, dim, n, probes, centroids)


def open_index(spark: SparkSession, path: str) -> NearestIndex:
    about = spark.read.parquet(f"{path}/about").first()
    stored = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    return NearestIndex(path, about["dim"], about["n"], about["probes"], np.array(stored["v"].tolist(), dtype="float64").reshape(len(stored), about["dim"]))


def _fit(rows: DataFrame, cells: int, sample: int, n: int, seed: int) -> np.ndarray:
    known = F.exists("v", lambda x: x != 0)
    picked = sampled(rows, "item_id", sample, n).filter(known).select(array_to_vector("v").alias("features")).cache()
    try:
        if picked.isEmpty():
            return np.zeros((1, len(rows.first()["v"])))
        model = KMeans(k=max(cells, 2), distanceMeasure="cosine", seed=seed, maxIter=12).fit(picked) if cells > 1 else None
        found = np.array(model.clusterCenters()) if model else np.array([picked.first()["features"].toArray()])
    finally:
        picked.unpersist()
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, norm, out=np.zeros_like(found), where=norm > 0)


def _store(rows: DataFrame, centroids: np.ndarray, path: str, n: int) -> None:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(cell=_nearest_cells(_matrix(part["v"]), shared.value, 1)[:, 0].astype("int32"))

    # Placed rows are written down before they are counted and dealt: the product with the centroids is taken once.
    placed = rows.mapInPandas(place, "item_id long, v array<double>, cell int") if len(centroids) else rows.withColumn("cell", F.lit(0))
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces"))
    dealt = placed.join(F.broadcast(sizes), "cell")  # a row per cell
    piece = F.pmod(F.xxhash64("item_id", "v"), F.col("pieces")).cast("int")
    parts = max(1, -(-n // PIECE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = dealt.select("cell", piece.alias("piece"), "item_id", "v").repartitionByRange(parts, "cell", "piece", "item_id").sortWithinPartitions("cell", "piece")
    stored.write.parquet(f"{path}/rows")


def _read(spark: SparkSession, index: NearestIndex) -> DataFrame:
    return spark.read.schema("cell int, piece int, item_id long, v array<double>").parquet(f"{index.path}/rows")


def _calibrate(index: NearestIndex, rows: DataFrame, recall: float, k: int, n: int) -> int:
    """Smallest number of probed cells that finds the wanted share of the true neighbours of the sampled rows (themselves left out)."""
    spark = rows.sparkSession
    trials = sampled(rows, "item_id", TRIALS, n).select(F.col("item_id").alias("query_id"), "v").toPandas()
    asked = spark.createDataFrame(trials, "query_id long, v array<double>")
    hits = top_k(asked, rows, k, "query_id", "v", "item_id", "v", skip_self=True).select("query_id", "item_id").toPandas()
    if not len(hits):
        return index.cells
    wanted = spark.createDataFrame(hits, "query_id long, item_id long")  # TRIALS x k rows
    cells = _read(spark, index).select("item_id", "cell").join(F.broadcast(wanted), "item_id").groupBy("query_id", "item_id").agg(F.min("cell").alias("cell")).toPandas()
    order = _nearest_cells(_matrix(trials["v"]), index.centroids, index.cells)
    place = {(q, c): i + 1 for q, row in zip(trials["query_id"], order.tolist()) for i, c in enumerate(row)}
    needed = np.sort([place[x] for x in zip(cells["query_id"], cells["cell"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def search_index(
    index: NearestIndex, queries: DataFrame, k: int = 10, q_id: str = "query_id", q_vec: str = "embedding", probes: int | None = None, skip_self: bool = False,
    bound: int = BROADCAST_QUERIES,
) -> DataFrame:
    """(query_id, rank, item_id, score): the k best rows among the probed cells of each query.

    Up to `bound` queries travel to the stored rows, of which the probed cells alone are read, and tasks pass on their k best per query. More queries are sent to
    their cells and meet them piece by piece; the corpus moves as often as a cell has blocks of `PIECE_ROWS` queries.
    """
    spark = queries.sparkSession
    n = min(index.probes if probes is None else probes, index.cells)
    asked = _vectors(queries, q_id, q_vec, "query_id", index.dim)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, item_id long, score double")
    head = asked.limit(bound + 1).toPandas()
    hits = _probe_all(spark, index, head, k, n, skip_self) if len(head) <= bound else _meet(spark, index, asked, k, n, skip_self)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def _probe_all(spark: SparkSession, index: NearestIndex, queries: pd.DataFrame, k: int, probes: int, skip_self: bool) -> DataFrame:
    ids = queries["query_id"].to_numpy(dtype="int64")
    vectors = _matrix(queries["v"]) if len(queries) else np.zeros((0, index.dim))
    cells = _nearest_cells(vectors, index.centroids, probes)
    order = np.argsort(cells.ravel(), kind="stable")
    by_cell, first = np.unique(cells.ravel()[order], return_index=True)
    asking = dict(zip(by_cell.tolist(), np.split(np.repeat(np.arange(len(ids)), probes)[order], first[1:])))
    shared = spark.sparkContext.broadcast((ids, vectors, asking))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, asking = shared.value
        best = Best(ids, vectors, k, skip_self)
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                if cell in asking:
                    best.offer(part["item_id"].to_numpy(dtype="int64"), _matrix(part["v"]), asking[cell])
        yield best.rows()

    rows = _read(spark, index)
    if probes < index.cells:
        rows = rows.filter(F.col("cell").isin([int(c) for c in by_cell]))
    return rows.select("cell", "item_id", "v").mapInPandas(scan, _HITS)


def _meet(spark: SparkSession, index: NearestIndex, queries: DataFrame, k: int, probes: int, skip_self: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(index.centroids)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(cells=_nearest_cells(_matrix(part["v"]), shared.value, probes).tolist())

    routed = queries.mapInPandas(route, "query_id long, v array<double>, cells array<int>")
    rows = _read(spark, index)
    # A row per cell on either side: at most MAX_CELLS.
    pieces = F.broadcast(rows.groupBy("cell").agg((F.max("piece") + 1).alias("pieces")))
    blocks = F.broadcast(routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("blocks")))
    q = routed.select("query_id", "v", F.explode("cells").alias("cell")).join(blocks, "cell").join(pieces, "cell")
    q = q.select("query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    c = rows.join(blocks, "cell").select("cell", "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "item_id", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        return _best(left["query_id"].to_numpy(dtype="int64"), _matrix(left["v"]), right["item_id"].to_numpy(dtype="int64"), _matrix(right["v"]), k, skip_self)

    keys = ["cell", "piece", "block"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, _HITS)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, hit, recall): how many of the exact neighbours were found."""
    both = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("_f")).distinct(), ["query_id", "item_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_f").alias("hit")).withColumn("recall", F.try_divide(F.col("hit"), F.col("wanted")))
