"""The prefix trie against a plain loop: shared prefixes over several blocks, copies, turnless conversations, nulls, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from qaforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, pos int, node long, depth string"


def plain_trie(seqs):
    """Rows of the trie of sequences by conversation."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) if children[path] else 1
        saved[path] = own + sum(saved[k] for k in children[path])
    out = set()
    for path, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(seqs[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.add((cs[0], len(path), parent, len(cs), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain_turns(rows):
    """Ordered turns by conversation; equal turn numbers follow the digest of the turn."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, digest, (role, text)))
    return {c: tuple(x[3] for x in sorted(ts)) for c, ts in turns.items()}


def plain_rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + (-c) % 5
        out[c] = own.get(base, ())[:h] + own[c][h:]
    return out


def as_set(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for c in [*range(-12, 60), 1000, 1003, 2**63 - 1]:
        if c in (20, 35):  # groups without their first conversation
            continue
        kind = r.random()
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            text = "same" if kind < 0.3 else f"say {r.randrange(2)} é"
            out.append((c, t if r.random() < 0.9 else None, r.choice(["user", None]) if kind > 0.6 else "user", None if r.random() < 0.1 else text))
    out += [(50, 3, "user", "same")] * 3 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    # A conversation far longer than the others, and a copy of it that ends elsewhere.
    out += [(c, t, "user", f"long {t}") for c, n in ((100, 20), (105, 17)) for t in range(n)]
    return [(*x, "mine", 7, 8, "d") for x in out]


@pytest.mark.parametrize("width", [3, 8])
def test_rebuilt_trie(spark, rows, width):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = as_set(trie.rebuilt_trie(df, width=width))
    assert got == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_trie_of_own_turns(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_set(trie.prefix_trie(trie.turn_rows(df), width=4)) == plain_trie(plain_turns(rows))


def test_hot_nodes_and_long_conversations(spark, rows, monkeypatch):
    """With a low bound every lookup is split between broadcast and shuffle, and groups are numbered over several tasks."""
    monkeypatch.setattr(trie, "SHARE", 10)
    monkeypatch.setattr("qaforge.operators.ranking.MAX_GROUP", 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_set(trie.rebuilt_trie(df, width=4)) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_ends_over_many_stretches(spark):
    ids = [*range(-3000, 6000, 7), 10**12, -(10**12)]
    ends = spark.createDataFrame([(5, 2, c) for c in ids] + [(6, 2, 6)], "conv_id long, depth long, member long").repartition(8)
    got = {r.conv_id: r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got == {5: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 6: hashlib.sha256(b"6").hexdigest()}


def test_turnless_and_empty(spark):
    # 1 takes three turns from a conversation that is not there, and has no more of its own.
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert as_set(trie.rebuilt_trie(df)) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}
    assert trie.rebuilt_trie(df.limit(0)).count() == 0
    assert trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], df.schema)).count() == 0
