"""The stored index of cells against the exact search."""

import numpy as np
import pytest

from qaforge.operators import nearest as N
from qaforge.operators import retrieval as RT
from qaforge.operators.retrieval import top_k


def frame(spark, ids, vectors, name):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "mine") for i, v in zip(ids, vectors)], f"{name} long, embedding array<float>, cell string").repartition(4)


@pytest.fixture(scope="module")
def corpus(spark):
    """Vectors in 40 bunches, a third of all in one of them, and odd rows."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 12))
    which = np.where(r.random(3000) < 1 / 3, 0, r.integers(0, 40, 3000))
    vectors = list(centres[which] + 0.35 * r.normal(size=(3000, 12)))
    vectors += [np.zeros(12), None, vectors[0], vectors[0]]
    ids = [*range(3000), 3000, 3001, 3002, 0]
    return frame(spark, ids, vectors, "item_id"), frame(spark, ids[::50], vectors[::50], "query_id")


def rows(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return N.build_index(corpus[0], f"{tmp_path_factory.mktemp('index')}/i", cells=40)


@pytest.mark.parametrize("bound", [1000, 0])
def test_recall_with_few_cells_probed(spark, corpus, index, bound):
    assert 30 <= index.cells <= 40 and index.probes <= index.cells // 3 and index.rows == 3004
    stored = N.open_index(spark, index.path)
    assert (stored.probes, stored.rows, stored.cells) == (index.probes, 3004, index.cells) and np.allclose(stored.centroids, index.centroids)
    found = N.search_index(stored, corpus[1], 10, skip_self=True, bound=bound)
    exact = top_k(corpus[1], corpus[0].fillna({}).filter("embedding is not null"), 10, skip_self=True)
    assert N.recall_against(found, exact).first()["recall"] >= 0.9
    assert all(r["rank"] <= 10 for r in found.collect())


@pytest.mark.parametrize("bound", [1000, 0])
def test_all_cells_give_the_exact_result(corpus, index, bound):
    # A null vector is one of zeros.
    whole = corpus[0].selectExpr("item_id", "coalesce(embedding, array_repeat(0f, 12)) embedding")
    for skip in (False, True):
        got = rows(N.search_index(index, corpus[1], 5, probes=10**6, skip_self=skip, bound=bound))
        assert got == rows(top_k(corpus[1], whole, 5, skip_self=skip))


def test_cells_and_queries_in_pieces(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PIECE_ROWS", 100)
    index = N.build_index(corpus[0], f"{tmp_path}/i", cells=8)
    assert spark.read.parquet(f"{index.path}/rows").agg({"piece": "max"}).first()[0] >= 9
    many = corpus[0].filter("embedding is not null").selectExpr("item_id as query_id", "embedding").dropDuplicates(["query_id"])
    found = N.search_index(index, many, 3, probes=index.cells, bound=0)
    whole = corpus[0].selectExpr("item_id", "coalesce(embedding, array_repeat(0f, 12)) embedding")
    assert rows(found) == rows(top_k(many, whole, 3))


def test_small_and_empty(spark, corpus, tmp_path):
    none = N.build_index(corpus[0].limit(0), f"{tmp_path}/none")
    assert none.cells == 0 and N.search_index(none, corpus[1]).count() == 0
    zeros = N.build_index(frame(spark, [1, 2], [[0, 0], [0, 0]], "item_id"), f"{tmp_path}/zeros")
    assert rows(N.search_index(zeros, frame(spark, [7], [[1, 0]], "query_id"))) == [(7, 1, 1, 0.0), (7, 2, 2, 0.0)]
    one = N.build_index(frame(spark, [1, 2], [[1, 0], [0, 1]], "item_id"), f"{tmp_path}/one")
    assert rows(N.search_index(one, frame(spark, [7, 8], [[1, 0], [0, 3]], "query_id"), 1)) == [(7, 1, 1, 1.0), (8, 1, 2, 1.0)]
    assert N.search_index(one, frame(spark, [], [], "query_id")).count() == 0


def test_best_rows_of_tiles(spark):
    """Several tiles, equal scores, repeated ids and queries that look past themselves, against a whole sort; then the strips, which stay apart and move each row a few times."""
    r = np.random.default_rng(9)
    c = np.round(r.normal(size=(5000, 3)))
    q, c_ids, q_ids = c[:300], r.integers(0, 4000, 5000), np.arange(300)
    for skip in (False, True):
        scores = q @ c.T
        if skip:
            scores[q_ids[:, None] == c_ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(c_ids, scores.shape), -scores), axis=1)[:, :4]
        best = RT.Best(q_ids, q, 4, skip)
        for i in range(0, 5000, 1700):
            best.offer(c_ids[i : i + 1700], c[i : i + 1700])
        assert (best.ids == c_ids[order]).all() and (best.scores == np.take_along_axis(scores, order, axis=1)).all()
    rows_ = frame(spark, range(5000), c, "item_id")
    grid = RT._grid(rows_.select(rows_.item_id.alias("query_id"), rows_.embedding.alias("v")), rows_.select("item_id", rows_.embedding.alias("v")), 2, False, 50)
    assert grid.rdd.getNumPartitions() >= 16
