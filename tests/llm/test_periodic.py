"""Periodic runs against a plain loop over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from qaforge.llm import periodic, queries


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text, edit=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if edit and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    kept = [True] * n
    for s, e, q in runs:
        kept[s + q : e] = [False] * (e - s - q)
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for x, k in zip(w, kept) if k).encode()).hexdigest())


def made_up(r):
    kind, n = r.random(), r.randrange(0, 120)
    if kind < 0.2:
        return [r.randrange(2) for _ in range(n)]
    if kind < 0.4:
        return [r.randrange(50) for _ in range(n)]
    if kind < 0.6:
        p = [r.randrange(3) for _ in range(r.randrange(1, 20))]
        return ([r.randrange(5) for _ in range(r.randrange(10))] + p * 10)[:n] + [r.randrange(5) for _ in range(r.randrange(10))]
    if kind < 0.8:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    unit = [r.randrange(3) for _ in range(3)] * r.randrange(1, 6) + [9]
    return (unit * 6)[r.randrange(len(unit)) :]


def sequence(docs):
    sizes = np.array([len(d) for d in docs], dtype="int64")
    starts = np.cumsum(sizes) - sizes + np.arange(len(docs)) + 1
    return np.array([-1] + [x for k, d in enumerate(docs) for x in [*d, -2 - k]]), starts, sizes


@pytest.mark.parametrize("step", [40, 1000, 1 << 20])
def test_runs(step):
    r = random.Random(step)
    for _ in range(12):
        docs = [made_up(r) for _ in range(30)]
        seq, starts, sizes = sequence(docs)
        low, high, q = periodic.find_runs(seq, starts, sizes, step=step)
        assert sorted(zip(low, high, q)) == sorted((s + starts[k], e + starts[k], p) for k, d in enumerate(docs) for s, e, p in plain_runs(d))
    with pytest.raises(ValueError):
        periodic.find_runs(seq, starts, sizes, least=5)


def test_grammar_spells_its_words_and_extends_exactly():
    r = random.Random(8)
    for _ in range(10):
        seq, _, _ = sequence([made_up(r) for _ in range(8)])
        g = periodic.recompress(seq)
        # A symbol's children spell it: sizes add up, and its first place below is where it begins.
        place = np.cumsum(np.concatenate([[0], g.size[: len(seq)]]))[:-1]
        assert place.tolist() == list(range(len(seq)))
        above = np.flatnonzero(g.down >= 0)
        assert all(g.size[g.down[k] : g.down_end[k] + 1].sum() == g.size[k] for k in above.tolist())
        assert all(g.up[g.down[k]] == k and g.up_end[g.down_end[k]] == k for k in above.tolist())
        a, b = np.array([sorted(r.sample(range(1, len(seq) - 1), 2)) for _ in range(300)]).T
        ahead, behind = periodic.extensions(g, a, b), periodic.extensions(g, a, b, left=True)
        for x, y, right, left in zip(a.tolist(), b.tolist(), ahead.tolist(), behind.tolist()):
            assert right == next(k for k in range(len(seq)) if seq[x + k] != seq[y + k])
            assert left == next(k for k in range(len(seq)) if seq[x - k] != seq[y - k])


def test_long_periodic_texts():
    for unit, n in (([5], 50_000), ([1, 2, 3, 4, 5, 6, 7], 8_000), (list(range(3000)), 4)):
        seq, starts, sizes = sequence([unit * n])
        low, high, q = periodic.find_runs(seq, starts, sizes)
        assert [low.tolist(), high.tolist(), q.tolist()] == [[1], [1 + len(unit) * n], [len(unit)]]


@pytest.fixture(scope="module")
def rows():
    hit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    r = random.Random(2)
    texts = [None, "", " \n ", "one", "a " * 5, "a " * 12, "a\tb b\n" * 9, "é ü " * 20, "x y z " * 4 + "x y q " * 4, " ".join(f"w{r.randrange(300)}" for _ in range(2500))]
    out = [(i, t) for i, t in enumerate(texts)] + [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 90)))) for i in hit]
    return [*out, out[-1], out[7], (None, "b c " * 9), (None, None)]


def test_table(spark, rows):
    df = spark.createDataFrame([(*x, "mine", 1, "p") for x in rows], "doc_id long, text string, runs string, n_words int, period string")
    for edit in (True, False):
        got = periodic.digest(periodic.collapse_runs(df.repartition(3), edit=edit)).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(plain_row(i, t, edit)) for i, t in rows)
    assert periodic.digest(periodic.collapse_runs(df.limit(0))).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "start " + "buy it now " * 6 + "end"), (2, "plain  words\n here")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapse_runs(df).collect()}
    assert got[1].text == "start buy it now end" and [tuple(r) for r in got[1].runs] == [(1, 18, 3)] and got[1].n_words == 20
    assert got[2].text == "plain words here" and got[2].runs == []


def test_query_on_all_documents(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    short = [d for d in table if len(d["text"] or "") < 40_000]
    assert len(short) > 150 and len(got) == len(table)
    assert [got[d["doc_id"]] for d in short] == [plain_row(d["doc_id"], d["text"]) for d in short]
