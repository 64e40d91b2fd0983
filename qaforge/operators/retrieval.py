"""Nearest questions, response scores and candidate ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions import vectors as V
from qaforge.operators.ranking import row_number_by

# Query vectors sent to every task at once; more of them are worked off in blocks of corpus and query rows.
BROADCAST_QUERIES = 4096
BLOCK_ROWS = 65_536
# Queries and corpus rows of one matrix product.
TILE_QUERIES, TILE_ROWS = 256, 2048

_HITS = "query_id long, item_id long, score double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Best:
    """The k best corpus rows so far of each query; ties go to the smaller id. Takes k rows per query, whatever it is offered."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> None:
        self.q_ids, self.q, self.k, self.skip_self = q_ids, q, k, skip_self
        self.scores = np.full((len(q_ids), k), -np.inf)
        self.ids = np.zeros((len(q_ids), k), dtype=np.int64)

    def offer(self, c_ids: np.ndarray, c: np.ndarray, places: np.ndarray | None = None) -> None:
        """Offer corpus rows to all queries, or to those at `places`."""
        order = np.argsort(c_ids, kind="stable")
        c_ids, c = c_ids[order], c[order]
        places = np.arange(len(self.q_ids)) if places is None else places
        for i in range(0, len(places), TILE_QUERIES):
            at = places[i : i + TILE_QUERIES]
            for j in range(0, len(c_ids), TILE_ROWS):
                self._tile(at, c_ids[j : j + TILE_ROWS], c[j : j + TILE_ROWS])

    def _tile(self, at: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> None:
        found = self.q[at] @ c.T
        if self.skip_self:
            low, high = np.searchsorted(c_ids, self.q_ids[at]), np.searchsorted(c_ids, self.q_ids[at], side="right")
            for i in np.flatnonzero(high > low):
                found[i, low[i] : high[i]] = -np.inf
        # What a row must reach: the worst row held or, while there are not k of them, the k-th of this tile.
        least = self.scores[at, -1]
        if c.shape[0] > self.k and np.isneginf(least).any():
            least = np.maximum(least, -np.partition(-found, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((found >= least[:, None]) & np.isfinite(found))
        if not len(rows):
            return
        rows = np.concatenate([np.repeat(np.arange(len(at)), self.k), rows])
        ids = np.concatenate([self.ids[at].ravel(), c_ids[columns]])
        scores = np.concatenate([self.scores[at].ravel(), found[rows[len(at) * self.k :], columns]])
        order = np.lexsort((ids, -scores, rows))
        starts = np.searchsorted(rows[order], np.arange(len(at)))
        kept = order[starts[:, None] + np.arange(self.k)]
        self.scores[at], self.ids[at] = scores[kept], ids[kept]

    def rows(self) -> pd.DataFrame:
        at, place = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": self.q_ids[at], "item_id": self.ids[at, place], "score": self.scores[at, place]})


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """The k best corpus rows per query of one block; ties go to the smaller id."""
    best = Best(q_ids, q, k, skip_self)
    best.offer(c_ids, c)
    return best.rows()


def top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 2, q_id: str = "query_id", q_vec: str = "embedding",
    c_id: str = "item_id", c_vec: str = "embedding", skip_self: bool = False, bound: int = BROADCAST_QUERIES,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, item_id, score): the k most similar corpus rows per query by cosine, exact.

    Each task scores blocks as a matrix product and passes on only its k best per query, so what is shuffled is k rows
    per query and task. Up to `bound` queries travel to the corpus; beyond that corpus and queries are cut into
    strips that meet on a strip key, so no task holds more than one strip of each. A strip has up to `block` or
    `BLOCK_ROWS` rows, whichever is more: every row is shuffled once per strip of the other side, so short blocks do not multiply what is moved.
    """
    q = queries.select(F.col(q_id).cast("long").alias("query_id"), F.col(q_vec).alias("v"))
    c = corpus.select(F.col(c_id).cast("long").alias("item_id"), F.col(c_vec).alias("v"))
    head = q.limit(bound + 1).toPandas()
    if len(head) <= bound:
        hits = _scan(c, head, k, skip_self)
    else:
        hits = _grid(q, c, k, skip_self, block)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    # The rank limit is applied before the shuffle as well, so a query never gathers more than k rows per task.
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "item_id", "score"
    )


def _scan(corpus: DataFrame, queries: pd.DataFrame, k: int, skip_self: bool) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        (queries["query_id"].to_numpy(dtype=np.int64), _matrix(queries["v"]) if len(queries) else None)
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        if not len(ids):
            return
        best = Best(ids, m, k, skip_self)
        for part in batches:
            if len(part):
                best.offer(part["item_id"].to_numpy(dtype=np.int64), _matrix(part["v"]))
        yield best.rows()

    return corpus.mapInPandas(scan, _HITS)


def _grid(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, block: int) -> DataFrame:
    counts, cores = (queries.count(), corpus.count()), corpus.sparkSession.sparkContext.defaultParallelism

    def strips(rows: int) -> int:
        # As few strips as fit, but enough of them to occupy all cores.
        return max(1, -(-rows // max(block, BLOCK_ROWS)), min(math.isqrt(4 * cores), -(-rows // min(block, TILE_ROWS))))

    n_q, n_c = strips(counts[0]), strips(counts[1])
    parts = min(n_q * n_c, 4 * max(cores, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    c = corpus.withColumn("cb", F.pmod(F.xxhash64("item_id"), F.lit(n_c)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    )
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        return _best(
            left["query_id"].to_numpy(dtype=np.int64), _matrix(left["v"]),
            right["item_id"].to_numpy(dtype=np.int64), _matrix(right["v"]), k, skip_self,
        )

    # The number of parts is given: small strips with much work must not be put together in one task.
    q, c = q.repartition(parts, "qb", "cb"), c.repartition(parts, "qb", "cb")
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(meet, _HITS)


def answer_top_k(queries: DataFrame, corpus: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, rank, item_id, question, answer, score) over `corpus(item_id, question, answer, embedding)`."""
    hits = top_k(queries, corpus, k)
    return hits.join(corpus.select("item_id", "question", "answer"), "item_id").select(
        "query_id", "rank", "item_id", "question", "answer", "score"
    )


def nearest_others(items: DataFrame, corpus: DataFrame, n: int = 2, id_col: str = "item_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, item_id, score): the n most similar other rows of each item."""
    return top_k(items, corpus, n, id_col, vec, id_col, vec, skip_self=True)


def pair_similarity(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add the cosine of two vector columns and its wording."""
    return df.withColumn("score", V.cosine(F.col(left), F.col(right))).withColumn("verdict", V.pair_verdict(F.col("score")))


def score_response(prompt: Column, response: Column, mode: str = "word") -> Column:
    """Keyword overlap plus a bounded bonus for length."""
    overlap = V.jaccard(F.array_distinct(L.keywords(prompt, mode)), F.array_distinct(L.keywords(response, mode)))
    return overlap + F.least(F.length(response) / F.lit(600.0), F.lit(0.3))


def best_of_n(candidates: DataFrame, query: str = "query_id", score: str = "score", arrival: str = "arrival") -> DataFrame:
    """Add the place of each candidate within its query, best first; ties keep the order of arrival."""
    return row_number_by(candidates, [query], [F.col(score).desc(), F.col(arrival)], "place")


def best_candidate(candidates: DataFrame, query: str = "query_id", score: str = "score", arrival: str = "arrival") -> DataFrame:
    """Only the best candidate per query; one row per query and task is shuffled."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    rank = F.struct(F.col(score).alias("s"), (-F.col(arrival)).alias("a"))
    return candidates.groupBy(query).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def evaluate(
    df: DataFrame, response: str, domains: str, personas: str, intent: str, q_vec: str | None = None, r_vec: str | None = None
) -> DataFrame:
    """Add relevance (cosine, null without vectors), completeness (labels found, case-sensitive) and confidence."""
    text = F.coalesce(F.col(response), F.lit(""))
    wanted = F.concat(F.col(domains), F.col(personas), F.array(F.col(intent)))
    found = F.size(F.filter(wanted, lambda w: F.contains(text, w)))
    sure = F.when(F.contains(text, F.lit("confident")) | F.contains(text, F.lit("certain")), 0.1).otherwise(0.0)
    relevance = V.cosine(F.col(q_vec), F.col(r_vec)) if q_vec and r_vec else F.lit(None).cast("double")
    return df.withColumns(
        {
            "relevance": relevance,
            "completeness": found / F.size(wanted),
            "confidence": F.least(F.length(text) / 100.0 + sure, F.lit(1.0)),
        }
    )


def pick_candidates(
    candidates: DataFrame, forced: Sequence[str] = (), n: int = 1, query: str = "query_id", key: str = "model_key"
) -> DataFrame:
    """Per query: all forced keys in their order, then others by name up to n in total; n below 1 takes all."""
    place = F.array_position(F.array(*[F.lit(f) for f in forced]), F.col(key)) if forced else F.lit(0)
    pos = F.when(place > 0, place)
    ranked = row_number_by(candidates.withColumn("_pos", pos), [query], [F.col("_pos").asc_nulls_last(), F.col(key)], "place")
    kept = ranked if n < 1 else ranked.filter(F.col("_pos").isNotNull() | (F.col("place") <= n))
    return kept.drop("_pos")


def search_qa(qa: DataFrame, term: str | None, min_len: int = 20, q: str = "question", a: str = "answer") -> DataFrame:
    """Pairs whose question contains the term and whose answer is long enough."""
    hit = F.contains(F.lower(F.col(q)), F.lit(term.lower())) if term else F.lit(True)
    return qa.filter(hit & (F.length(a) >= min_len))


def lookup_answer(asked: DataFrame, qa: DataFrame, keep: str = "first", q: str = "question", a: str = "answer", pos: str = "pos") -> DataFrame:
    """Add the first (or last) answer to the very same question, else "Not found"."""
    pick = F.min_by(a, pos) if keep == "first" else F.max_by(a, pos)
    table = qa.groupBy(q).agg(pick.alias("_a"))
    return asked.join(table, q, "left").withColumn(a, F.coalesce("_a", F.lit("Not found"))).drop("_a")


