"""Searches through a stored index of the embeddings; the queries are the rows whose id is divisible by 50."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qaforge.operators import nearest as N
from qaforge.operators import retrieval as RT
from qaforge.queries.base import query, table
from qaforge.session import checkpoint_dir


def _indexed(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    index = N.build_index(vectors, f"{checkpoint_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}")
    return vectors, vectors.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), index


@query("top_k_index")
def top_k_index(spark, d):
    _, asked, index = _indexed(spark, d)
    return N.search_index(index, asked, 10).withColumn("score", F.round("score", 6))


@query(
    "top_k_index_all",
    """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT query_id, rank, item_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def top_k_index_all(spark, d):
    """Every cell probed, by queries that meet the cells: the exact result."""
    _, asked, index = _indexed(spark, d)
    return N.search_index(index, asked, 10, probes=index.cells, skip_self=True, bound=0).withColumn("score", F.round("score", 6))


@query("top_k_index_recall", "SELECT 10 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def top_k_index_recall(spark, d):
    """Whether the search finds at least nine of ten true neighbours, the rows themselves left out."""
    vectors, asked, index = _indexed(spark, d)
    found = N.search_index(index, asked, 10, skip_self=True)
    exact = RT.top_k(asked, vectors, 10, skip_self=True)
    return N.recall_against(found, exact).select("wanted", (F.col("recall") >= 0.9).alias("reached"))
