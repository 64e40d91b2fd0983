"""Near copies of long texts: against the library, and how few pairs reach the exact comparison."""

import difflib
import random

import numpy as np
import pandas as pd

from qaforge.operators import dedupe as D


def words(rng, n=80):
    """Words of few syllables, so that texts made of them have nearly the same counts of characters."""
    return ["".join(rng.choices(["th", "an", "er", "in", "on", "re", "ed", "ha", "st"], k=rng.randrange(1, 4))) for _ in range(n)]


def prose(rng, vocabulary, n):
    out = ""
    while len(out) < n:
        out += " ".join(rng.choices(vocabulary, k=rng.randrange(4, 15))).capitalize() + rng.choice([". ", ", ", "? ", ". "])
    return out[:n]


def changed(rng, text, share):
    for _ in range(int(len(text) * share)):
        at, move = rng.randrange(len(text)), rng.random()
        if move < 0.8:
            text = text[:at] + rng.choice("abcxyz .T") + text[at + rng.randrange(3):]
        else:
            text = text[:at] + text[at + rng.randrange(12):]
    return text


def ratio(x, y):
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


def pairs_of_families(rng, n):
    vocabulary = words(rng)
    heads = [(prose(rng, vocabulary, rng.choice([40, 190, 205, 400])), prose(rng, vocabulary, rng.choice([0, 60, 199, 200, 900, 2500]))) for _ in range(4)]
    heads.append(("Than " * 60, "then " * 90))  # no character of these is rare
    rows = []
    for i in range(n):
        q, a = rng.choice(heads)
        rows.append((i, changed(rng, q, rng.choice([0, 0.01, 0.04, 0.08])), changed(rng, a, rng.choice([0, 0.01, 0.03, 0.06])) if a else a))
    return rows


def test_match_is_the_librarys():
    rng = random.Random(11)
    for _ in range(150):
        text = prose(rng, words(rng, rng.choice([3, 80])), rng.choice([1, 30, 199, 200, 201, 600, 1500]))
        x, y = (changed(rng, text, rng.choice([0, 0.01, 0.05, 0.3])) for _ in range(2))
        want = ratio(x, y)
        assert D._Match(0.0).ratio(x, y) == want
        got = D._Match(0.9).ratio(x, y)
        assert got == want if want >= 0.9 else got < 0.9


def test_long_near_copies_are_exact(spark):
    rows = pairs_of_families(random.Random(2), 70)
    alike = lambda x, y: all(ratio(x[c], y[c]) >= 0.9 for c in (1, 2))
    first = {}
    for r in rows:
        first.setdefault(r[1:], r)
    reps = list(first.values())
    want = {(x[0], y[0]) for x in reps for y in reps if x[0] < y[0] and alike(y, x)}
    kept = []
    for r in rows:
        if not any(alike(r, k) for k in kept):
            kept.append(r)
    assert len(want) > 20 and 5 < len(kept) < 65
    df = spark.createDataFrame(rows, "pos long, question string, answer string").repartition(3)
    assert {(r.earlier, r.later) for r in D.fuzzy_pairs(df).collect()} == want
    for crowd in (10_000, 16):
        assert sorted(r.pos for r in D.dedupe_fuzzy(df, crowd=crowd).collect()) == [k[0] for k in kept]


def test_tiles_bring_all_rows_together():
    sides: dict[int, dict[int, list[int]]] = {}
    for tile, side, n in D._tiles(np.arange(1200), np.arange(0), True):
        sides.setdefault(tile, {})[side] = n.tolist()
    met = [p for t in sides.values() for p in ([(x, y) for x in t[2] for y in t[2] if x < y] if 2 in t else [(x, y) for x in t[0] for y in t[1]])]
    assert len(met) == len(set(met)) == 1200 * 1199 // 2
    assert [(side, len(n)) for _, side, n in D._tiles(np.arange(600), np.arange(3), False)] == [(0, 512), (1, 3), (0, 88), (1, 3)]


def test_small_blocks_lose_no_pair(spark, monkeypatch):
    df = spark.createDataFrame(pairs_of_families(random.Random(4), 60), "pos long, question string, answer string")
    whole = {(r.earlier, r.later) for r in D.fuzzy_pairs(df).collect()}
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)
    assert {(r.earlier, r.later) for r in D.fuzzy_pairs(df).collect()} == whole and whole


def test_long_answers_to_one_question_are_told_apart_by_runs(spark):
    """Counts are alike in long answers of the same words; runs at rare characters leave only the near copy."""
    rng = random.Random(6)
    vocabulary = words(rng)
    rows = [(i, "How is this done?", prose(rng, vocabulary, 2500 + i)) for i in range(60)]
    rows.append((60, "How is this done?", rows[5][2][:-20]))
    df = spark.createDataFrame(rows, "pos long, question string, answer string")
    reps, _ = D._numbered(D._representatives(df, "question", "answer", "pos"), 0.9)
    assert [(r.earlier, r.later) for r in D._alike(reps, reps, 0.9, same=True).collect()] == [(5, 60)]


def test_counts_rule_out_texts_of_the_same_words():
    """The pairs of neighbours a match needs follow from the rare characters of the earlier text: nearly all of them, where blocks are few."""
    rng = random.Random(8)
    vocabulary = words(rng)
    rows = pd.DataFrame([(i, prose(rng, vocabulary, 300), prose(rng, vocabulary, 950)) for i in range(200)], columns=["n", "q", "a"])
    rows = rows.assign(lq=rows["q"].str.len(), la=rows["a"].str.len())
    block = D._Block(rows)
    left = sum(len(a) for a, _ in D._within_bounds(block, block, 0.9))
    for rare in block.rare.values():
        rare[:] = 1 << 30
    assert 10 * left < sum(len(a) for a, _ in D._within_bounds(block, block, 0.9))
