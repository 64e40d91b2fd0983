"""Duplicate removal: exact, first or last answer, either side, and near copies."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.functions.common import WS, strip
from qaforge.session import cut_lineage


def key_lower(*cols: Column) -> list[Column]:
    return [F.lower(c) for c in cols]


def key_squeezed(*cols: Column) -> list[Column]:
    """Lower-cased with white space squeezed and trimmed."""
    return [F.lower(strip(F.regexp_replace(c, f"{WS}+", " "))) for c in cols]


def digest(cols: Sequence[Column]) -> Column:
    """Fixed-size stand-in for a key of any length, so that wide keys are not shuffled or sorted."""
    parts = []
    for c in cols:
        text = F.coalesce(c.cast("string"), F.lit(""))
        parts += [F.when(c.isNull(), F.lit("n")).otherwise(F.length(text).cast("string")), F.lit(":"), text]
    return F.sha2(F.concat(*parts), 256)


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by `order`.

    An aggregate and not a window: each task keeps one row per key before the shuffle, so a key that holds a third
    of the table costs no more than any other.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(digest(keys).alias("_k")).agg(pick.alias("_row")).select("_row.*")


def dedupe_exact(df: DataFrame, keys: Sequence[Column], pos: str = "pos", keep: str = "first") -> DataFrame:
    """First (or last) row per key by position."""
    return first_per_key(df, keys, [F.col(pos)], last=keep == "last")


def dedupe_last_answer(df: DataFrame, page: str = "page_id", q: str = "question", a: str = "answer", pos: str = "pos") -> DataFrame:
    """Per page and question: the place of the first row with the answer of the last."""
    return df.groupBy(page, q).agg(F.min(pos).alias(pos), F.max_by(a, pos).alias(a))


def dedupe_first_answer(df: DataFrame, site: str = "site", q: str = "question", a: str = "answer", pos: str = "pos") -> DataFrame:
    """Per site and trimmed question: the first answer, trimmed; blank questions are left out."""
    asked = df.withColumn(q, strip(F.col(q))).filter(F.col(q) != "")
    return asked.groupBy(site, q).agg(F.min(pos).alias(pos), strip(F.min_by(a, pos)).alias(a))


def keep_first_unlinked(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Greedy selection: walk ids in order, keep one unless it is linked to an id already kept.

    `links(earlier, later)` holds each pair once. Per round, ids without an undecided earlier neighbour are decided
    together; the rounds needed equal the longest chain of decisions, not the number of ids.
    """
    state = cut_lineage(ids.select("id").distinct())
    pairs = cut_lineage(links.select("earlier", "later").distinct())
    kept: DataFrame | None = None
    while True:
        blocked = pairs.select(F.col("later").alias("id")).distinct()
        ready = state.join(blocked, "id", "left_anti")
        ready = cut_lineage(ready)
        kept = ready if kept is None else kept.unionByName(ready)
        if pairs.isEmpty():
            break
        dropped = cut_lineage(
            pairs.join(ready.withColumnRenamed("id", "earlier"), "earlier", "left_semi")
            .select(F.col("later").alias("id"))
            .distinct()
        )
        gone = ready.unionByName(dropped)
        state = cut_lineage(state.join(gone, "id", "left_anti"))
        # A pair is settled once either end is: a dropped earlier row no longer blocks, a dropped later row is done.
        pairs = cut_lineage(
            pairs.join(gone.withColumnRenamed("id", "earlier"), "earlier", "left_anti").join(
                dropped.withColumnRenamed("id", "later"), "later", "left_anti"
            )
        )
    return kept


def dedupe_either_side(df: DataFrame, scope: str = "url", q: str = "question", a: str = "answer", pos: str = "pos") -> DataFrame:
    """Keep a pair only if neither its question nor its answer belongs to a pair kept before it.

    Runs in rounds: the earliest undecided row of both its question and its answer is certainly kept, and every row
    sharing a side with it is dropped. Only per-side minima are shuffled, never pairs of rows.
    """
    rows = df.withColumns({"_q": digest([F.col(scope), F.col(q)]), "_a": digest([F.col(scope), F.col(a)])})
    # Copies of a whole pair can never survive their first one; settle them before the rounds.
    state = cut_lineage(rows.groupBy("_q", "_a").agg(F.min(pos).alias("_pos")))
    kept: DataFrame | None = None
    while not state.isEmpty():
        first_q = state.groupBy("_q").agg(F.min("_pos").alias("_mq"))
        first_a = state.groupBy("_a").agg(F.min("_pos").alias("_ma"))
        won = state.join(first_q, "_q").join(first_a, "_a").filter("_pos = _mq and _pos = _ma")
        won = cut_lineage(won.select("_q", "_a", "_pos"))
        kept = won if kept is None else kept.unionByName(won)
        state = cut_lineage(
            state.join(won.select("_q"), "_q", "left_anti").join(won.select("_a"), "_a", "left_anti")
        )
    if kept is None:
        return df
    return rows.join(kept.select("_q", "_a", F.col("_pos").alias(pos)), ["_q", "_a", pos], "left_semi").select(*df.columns)


def _places(text: str) -> dict[str, int]:
    """For each character of a text the set of its places, as the bits of an integer."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def common_in_order(x: str, y: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a word of bits at a time (Hyyrö). `where` holds the places of x if they are known."""
    low, least = 0, min(len(x), len(y))
    while low < least and x[low] == y[low]:
        low += 1
    high = 0
    while high < least - low and x[-1 - high] == y[-1 - high]:
        high += 1
    if where is not None and low + high < least // 4:
        low = high = 0
    x, y = x[low : len(x) - high], y[low : len(y) - high]
    if not x or not y:
        return low + high
    places, full = where if where is not None and not low + high else _places(x), (1 << len(x)) - 1
    rows = full
    for char in y:
        met = rows & places.get(char, 0)
        rows = ((rows + met) | (rows - met)) & full
    return low + high + len(x) - rows.bit_count()


# From this length of the earlier text on, the sequence matcher begins a match only at characters that are rare in it.
RARE_FROM = 200
# Pairs of places held at once; texts with more are left to the library, which takes longer and less memory.
STEP_POINTS = 3_000_000


def _starts(text: str, chars: Iterable[str]) -> dict[str, list[int]]:
    """Places of each of the characters."""
    out: dict[str, list[int]] = {}
    for char in chars:
        found, at = [], text.find(char)
        while at >= 0:
            found.append(at)
            at = text.find(char, at + 1)
        if found:
            out[char] = found
    return out


def _equal(x: str, i: int, y: str, j: int, most: int) -> int:
    """How many characters, `most` at most, are equal from place i of x and place j of y on."""
    n = 0
    while n + 64 <= most and x[i + n : i + n + 64] == y[j + n : j + n + 64]:
        n += 64
    while n < most and x[i + n] == y[j + n]:
        n += 1
    return n


def _equal_back(x: str, i: int, y: str, j: int, most: int) -> int:
    """The same before these places."""
    n = 0
    while n + 64 <= most and x[i - n - 64 : i - n] == y[j - n - 64 : j - n]:
        n += 64
    while n < most and x[i - n - 1] == y[j - n - 1]:
        n += 1
    return n


def _meeting_points(x: str, y: str, begin: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, equal characters up to there) of each pair of equal characters a match may begin at, in order of both places."""
    at, to = [], []
    for char, found in _starts(x, begin).items():
        at.append(np.repeat(np.array(found, dtype=np.int64), len(begin[char])))
        to.append(np.tile(np.array(begin[char], dtype=np.int64), len(found)))
    if not at:
        return (np.zeros(0, dtype=np.int64),) * 3
    keys = np.sort(np.concatenate(at) * len(y) + np.concatenate(to))
    i, j = np.divmod(keys, len(y))
    order = np.argsort(j - i, kind="stable")
    follows = (np.diff(i[order]) == 1) & (np.diff((j - i)[order]) == 0)
    n = np.arange(len(order))
    size = np.empty(len(order), dtype=np.int64)
    size[order] = n - np.maximum.accumulate(np.where(np.concatenate([[False], follows]), 0, n)) + 1
    return i, j, size


def matched(x: str, y: str, begin: dict[str, list[int]], need: float = 0.0) -> int:
    """Characters in the matching blocks of `difflib.SequenceMatcher(None, x, y)`; -1 as soon as they cannot come to `need`.

    `begin` has the places in y of the characters a match is begun at. Their pairs of places are found once and handed down as the texts are parted, so that not all of x is
    gone through for every block.
    """
    total, may = 0, min(len(x), len(y))
    todo = [(0, len(x), 0, len(y), *_meeting_points(x, y, begin))]
    while todo:
        if may < need - 1e-6:
            return -1
        alo, ahi, blo, bhi, at, to, sizes = todo.pop()
        besti, bestj, size = alo, blo, 0
        # The longest one; of these the first in x, then in y.
        if len(at):
            here = np.minimum(sizes, np.minimum(at - alo, to - blo) + 1)
            k = int(here.argmax())
            size = int(here[k])
            besti, bestj = int(at[k]) - size + 1, int(to[k]) - size + 1
        more = _equal_back(x, besti, y, bestj, min(besti - alo, bestj - blo))
        besti, bestj, size = besti - more, bestj - more, size + more
        size += _equal(x, besti + size, y, bestj + size, min(ahi - besti, bhi - bestj) - size)
        left, right = min(besti - alo, bestj - blo), min(ahi - besti, bhi - bestj) - size
        may += (size + left + right if size else 0) - min(ahi - alo, bhi - blo)
        total += size
        if size and left:
            end = int(at.searchsorted(besti))
            inside = (to[:end] < bestj).nonzero()[0]
            todo.append((alo, besti, blo, bestj, at[inside], to[inside], sizes[inside]))
        if size and right:
            start = int(at.searchsorted(besti + size))
            inside = (to[start:] >= bestj + size).nonzero()[0] + start
            todo.append((besti + size, ahi, bestj + size, bhi, at[inside], to[inside], sizes[inside]))
    return total if total >= need - 1e-6 else -1


class _Match:
    """Sequence-match ratios of texts at a threshold; a pair that cannot reach it gets -1."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.bags: dict[str, Counter] = {}
        self.places: dict[str, dict[str, int]] = {}
        self.begins: dict[str, dict[str, list[int]]] = {}

    def _bag(self, text: str) -> Counter:
        if text not in self.bags:
            if len(self.bags) > 4096:
                self.bags.clear()
            self.bags[text] = Counter(text)
        return self.bags[text]

    def _begin(self, y: str) -> dict[str, list[int]]:
        if y not in self.begins:
            if len(self.begins) > 64:
                self.begins.clear()
            most = len(y) // 100 + 1 if len(y) >= RARE_FROM else len(y)
            self.begins[y] = _starts(y, [c for c, n in self._bag(y).items() if n <= most])
        return self.begins[y]

    def ratio(self, x: str, y: str) -> float:
        """Ratio of the later text x to the earlier text y."""
        if x == y:
            return 1.0
        # Bounds from above, the cheaper one first: characters in common whatever their order, then in order. A long text is matched in less time than the second takes.
        whole = len(x) + len(y)
        need = self.threshold * whole / 2.0
        if (self._bag(x) & self._bag(y)).total() < need - 1e-6:
            return -1.0
        if len(y) < RARE_FROM:
            if y not in self.places:
                if len(self.places) > 64:
                    self.places.clear()
                self.places[y] = _places(y)
            if common_in_order(y, x, self.places[y]) < need - 1e-6:
                return -1.0
        begin = self._begin(y)
        if sum(len(found) * self._bag(x)[char] for char, found in begin.items()) > STEP_POINTS:
            return difflib.SequenceMatcher(None, x, y).ratio()
        found = matched(x, y, begin, need)
        return 2.0 * found / whole if found >= 0 else -1.0


# Buckets that characters and pairs of characters are counted in, and the rows and columns of texts compared at once.
ONE, TWO = 32, 256
TILE_ROWS, TILE_COLUMNS = 256, 2048
# Rows and characters of a block; a task holds two blocks. Rows a side that are compared by their answers at once.
BLOCK_ROWS, BLOCK_CHARS = 8192, 16_000_000
TILE_SIDE = 512
# Characters and pairs of rows looked at together.
STEP_CHARS, STEP_PAIRS = 2_000_000, 1_000_000
# Lengths of runs looked up at rare characters, the best first.
RUNS = (12, 8, 5)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _chunks(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items with at most `most` in all, or of one item."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _counted(texts: Sequence[str]) -> np.ndarray:
    """Per text: how many characters, then how many pairs of neighbouring characters, fall into each bucket; last, how many characters are rare.

    Rare are those the sequence matcher begins a match at if the text is the earlier one; in a text below RARE_FROM all may be.
    """
    out = np.empty((len(texts), ONE + TWO + 1), dtype=np.int32)
    for part in _chunks([len(t) for t in texts], STEP_CHARS):
        sizes = np.array([len(t) for t in texts[part]], dtype=np.int64)
        rows = len(sizes)
        codes, owner = _codes("".join(texts[part])), np.repeat(np.arange(rows), sizes)
        out[part, :ONE] = np.bincount(owner * ONE + codes % ONE, minlength=rows * ONE).reshape(rows, ONE)
        within = owner[:-1] == owner[1:]
        pairs = owner[:-1] * TWO + (codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA77 >> 12) % TWO
        out[part, ONE:-1] = np.bincount(pairs[within], minlength=rows * TWO).reshape(rows, TWO)
        kinds, n = np.unique(owner << 21 | codes, return_counts=True)
        of = kinds >> 21
        rare = np.bincount(of, weights=np.where(n <= sizes[of] // 100 + 1, n, 0), minlength=rows)
        out[part, -1] = np.where(sizes < RARE_FROM, 1 << 30, rare)
    return out


@F.pandas_udf(T.BinaryType())
def _profile(texts: pd.Series) -> pd.Series:
    """Counts of each text, in as few bytes per count as they need."""
    found = _counted(texts.tolist())
    kinds = [1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 for most in found[:, :-1].max(axis=1, initial=0).tolist()]
    return pd.Series([row[:-1].astype(f"<u{kind}").tobytes() + row[-1:].astype("<i4").tobytes() for row, kind in zip(found, kinds)], dtype=object)


def _profiles(parts: Sequence[bytes]) -> np.ndarray:
    out = np.empty((len(parts), ONE + TWO + 1), dtype=np.int32)
    for row, part in zip(out, parts):
        row[:-1] = np.frombuffer(part, dtype=f"<u{len(part) // (ONE + TWO)}", count=ONE + TWO)
        row[-1] = np.frombuffer(part, dtype="<i4", offset=len(part) - 4)[0]
    return out


def _span(threshold: float) -> float:
    """Lengths of a matching pair differ at most by this factor."""
    return (2 - threshold) / threshold + 1e-9


class _Block:
    """Rows of a block in order of the length of their questions; answers as texts or as profiles."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["lq", "n"])
        self.n = rows["n"].to_numpy(dtype=np.int64)
        self.q = rows["q"].tolist()
        self.a = rows["a"].tolist() if "a" in rows else []
        self.size = {c: rows[f"l{c}"].to_numpy(dtype=np.int64) for c in ("q", "a")}
        counts = {"q": _counted(self.q), "a": _counted(self.a) if self.a else _profiles(rows["pa"].tolist())}
        self.rare = {c: m[:, -1].astype(np.int64) for c, m in counts.items()}
        self.one = {c: np.ascontiguousarray(m[:, :ONE]) for c, m in counts.items()}
        self.two = {c: np.ascontiguousarray(m[:, ONE:-1]) for c, m in counts.items()}


def _within_bounds(l: _Block, r: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs that no count of characters rules out; of a block and itself only those with the earlier row left.

    Let m be the characters of a match and s the sum of both lengths; the ratio is 2m/s. At least m characters are common to both texts. A match is made of blocks of
    neighbours: b blocks have m - b pairs of neighbours, which are common as well. Each of the s - 2m characters left over parts at most two blocks, so b is at most
    s - 2m + 1. In an earlier text of RARE_FROM characters or more, each block but one at the beginning of both texts also has a character that is rare in it, so b is at most one more
    than these. Texts that share a bucket only raise the counts found.
    """
    span = _span(threshold)
    small = np.int16 if max(l.size["q"].max(initial=0), r.size["q"].max(initial=0)) < 30_000 else np.int32
    left, right = (np.ascontiguousarray(x.one["q"].T.astype(small)) for x in (l, r))

    def fitting(c: str, x: slice, y: slice) -> np.ndarray:
        one, two = l.size[c][x, None], r.size[c][None, y]
        return np.maximum(one, two) <= np.minimum(one, two) * span

    def common(c: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        whole = l.size[c][x] + r.size[c][y]
        least = threshold * whole / 2.0
        rare = np.where(l.n[x] < r.n[y], l.rare[c][x], r.rare[c][y])
        need = least - np.minimum(rare + 1, whole - 2 * least + 1)
        ok = np.minimum(l.two[c][x], r.two[c][y]).sum(axis=1) >= need - 1e-6
        ok[ok] = np.minimum(l.one[c][x[ok]], r.one[c][y[ok]]).sum(axis=1) >= least[ok] - 1e-6
        return ok

    for i in range(0, len(l.n), TILE_ROWS):
        x = slice(i, min(i + TILE_ROWS, len(l.n)))
        # Questions are in order of their lengths, so those that fit any row of the tile follow one another.
        first = int(np.searchsorted(r.size["q"], l.size["q"][x][0] / span - 1, "left"))
        last = int(np.searchsorted(r.size["q"], l.size["q"][x][-1] * span + 1, "right"))
        for j in range(first, last, TILE_COLUMNS):
            y = slice(j, min(j + TILE_COLUMNS, last))
            open_ = fitting("q", x, y) & fitting("a", x, y)
            if l is r:
                open_ &= l.n[x, None] < r.n[None, y]
            if not open_.any():
                continue
            met = np.zeros(open_.shape, dtype=small)
            least = np.empty_like(met)
            for k in range(ONE):
                np.minimum(left[k, x, None], right[k, None, y], out=least)
                met += least
            whole = l.size["q"][x, None] + r.size["q"][None, y]
            open_ &= met >= threshold * whole / 2.0 - 1e-6
            at, to = np.nonzero(open_)
            for k in range(0, len(at), 1 << 13):
                a, b = at[k : k + (1 << 13)] + i, to[k : k + (1 << 13)] + j
                for c in ("q", "a"):
                    ok = common(c, a, b)
                    a, b = a[ok], b[ok]
                if len(a):
                    yield a, b


def _runs(codes: np.ndarray, size: int) -> np.ndarray:
    """Digest of the run of `size` characters that begins at each place."""
    out = np.zeros(max(len(codes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)].astype(np.uint64)
    return out


def _anchors(text: str) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(length of runs, characters matched at most if no run is met, digests of runs, what each may add) of an earlier text.

    Blocks of a match hold a rare character (see _within_bounds), so what lies between two rare characters that follow one another is matched from the one forwards and from the other
    backwards. A block that goes on for a run's length from a rare character has that run in the later text; if the run is not there, the block ends before. What precedes the first rare
    character counts as matched.
    """
    codes = _codes(text)
    rare = np.flatnonzero(np.bincount(codes)[codes] <= len(codes) // 100 + 1) if len(codes) >= RARE_FROM else []
    if not len(rare):
        return None
    between, tail = np.diff(rare) - 1, len(codes) - 1 - int(rare[-1])
    for size in RUNS:
        short = size - 2
        base = len(rare) + int(rare[0]) + int(np.minimum(between, 2 * short).sum()) + min(tail, short)
        if base <= 0.65 * len(codes):
            break
    wide = np.flatnonzero(between > 2 * short)
    at = np.concatenate([rare[wide], rare[wide + 1] - size + 1, rare[-1:][: tail > short]])
    adds = between[wide] - 2 * short
    return size, base, _runs(codes, size)[at], np.concatenate([adds, adds, [tail - short][: tail > short]])


def _reachable(early: Sequence[str], late: Sequence[str], e: np.ndarray, l: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (place of the earlier, place of the later text) can still reach the threshold by the runs they have in common."""
    ok = np.ones(len(e), dtype=bool)
    known = {i: found for i in np.unique(e).tolist() if (found := _anchors(early[i])) is not None}
    sizes = [np.array([len(t) for t in texts], dtype=np.int64) for texts in (early, late)]
    for size in RUNS:
        ys = np.array([i for i, found in known.items() if found[0] == size], dtype=np.int64)
        if not len(ys):
            continue
        # (place among ys, or -1) of each pair
        place = np.full(len(early), -1)
        place[ys] = np.arange(len(ys))
        base = np.array([known[i][1] for i in ys.tolist()])
        keys, adds = (np.concatenate([known[i][k] for i in ys.tolist()]) for k in (2, 3))
        owner = np.repeat(np.arange(len(ys)), [len(known[i][2]) for i in ys.tolist()])
        seen = np.zeros(1 << 22, dtype=bool)
        seen[(keys >> np.uint64(42)).astype(np.int64)] = True
        mine = np.flatnonzero(place[e] >= 0)
        xs = np.unique(l[mine])
        for part in _chunks(sizes[1][xs].tolist(), STEP_CHARS):
            some = xs[part]
            codes, row = _codes("".join([late[i] for i in some.tolist()])), np.repeat(np.arange(len(some)), sizes[1][some])
            runs = _runs(codes, size)
            row = np.where(row[: len(runs)] == row[size - 1 :], row[: len(runs)], -1)
            may = np.flatnonzero(seen[(runs >> np.uint64(42)).astype(np.int64)] & (row >= 0))
            # Each run once per text, in order of their digests.
            order = may[np.lexsort((row[may], runs[may]))]
            runs, row = runs[order], row[order]
            if len(runs):
                once = np.concatenate([[True], (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])])
                runs, row = runs[once], row[once]
            at = np.full(len(late), -1)
            at[some] = np.arange(len(some))
            here = mine[at[l[mine]] >= 0]
            here = here[np.argsort(place[e[here]], kind="stable")]
            whose = place[e[here]]
            low, high = np.searchsorted(runs, keys, "left"), np.searchsorted(runs, keys, "right")
            hits = np.bincount(owner, weights=high - low, minlength=len(ys)).astype(np.int64)
            for y in _chunks(np.maximum(hits, len(some)).tolist(), STEP_PAIRS):
                k = slice(*np.searchsorted(owner, [y.start, y.stop]))
                n = (high - low)[k]
                of = np.repeat(np.arange(k.start, k.stop), n)
                met = row[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]]
                cells = (owner[of] - y.start) * len(some) + met
                gain = np.bincount(cells, weights=adds[of], minlength=(y.stop - y.start) * len(some))
                p = here[slice(*np.searchsorted(whose, [y.start, y.stop]))]
                least = threshold * (sizes[0][e[p]] + sizes[1][l[p]]) / 2.0
                ok[p] = base[place[e[p]]] + gain[(place[e[p]] - y.start) * len(some) + at[l[p]]] >= least - 1e-6
    return ok


def _both(rows: pd.DataFrame) -> tuple[_Block, _Block]:
    """The blocks of a meeting; a block that meets itself comes twice."""
    if (rows["side"] == 2).any():
        block = _Block(rows)
        return block, block
    return _Block(rows[rows["side"] == 0]), _Block(rows[rows["side"] == 1])


def _open_pairs(l: _Block, r: _Block, threshold: float) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray]]:
    """(block of the earlier rows, of the later rows, places in the one, in the other) of pairs that neither counts nor the runs of the questions rule out; some at a time."""

    def left(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[_Block, _Block, np.ndarray, np.ndarray]]:
        a, b = map(np.concatenate, zip(*held))
        first = l.n[a] < r.n[b]
        for e, x, i, j in ((l, r, a[first], b[first]), (r, l, b[~first], a[~first])):
            if len(i):
                ok = _reachable(e.q, x.q, i, j, threshold)
                yield e, x, i[ok], j[ok]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for pairs in _within_bounds(l, r, threshold):
        held.append(pairs)
        n += len(pairs[0])
        if n >= STEP_PAIRS:
            yield from left(held)
            held, n = [], 0
    if held:
        yield from left(held)


def _suspects(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, left and right, have a partner with a question that may be alike and an answer that the counts do not rule out."""
    l, r = _both(rows)
    marks = {x: np.zeros(len(x.n), dtype=bool) for x in (l, r)}
    ids = {q: i for i, q in enumerate({*l.q, *r.q})}
    own = {x: np.array([ids[q] for q in x.q], dtype=np.int64) for x in (l, r)}
    match = _Match(threshold)
    for e, x, i, j in _open_pairs(l, r, threshold):
        # Runs say little about a short question; it is compared.
        sure = (own[e][i] == own[x][j]) | (e.size["q"][i] >= RARE_FROM)
        marks[e][i[sure]] = marks[x][j[sure]] = True
        left = ~(marks[e][i] & marks[x][j])
        for i, j in zip(i[left].tolist(), j[left].tolist()):
            if not (marks[e][i] and marks[x][j]) and match.ratio(x.q[j], e.q[i]) >= threshold:
                marks[e][i] = marks[x][j] = True
    return l.n[marks[l]], r.n[marks[r] & (l is not r)]


def _candidates(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(earlier, later, ratio of the questions) of the pairs whose questions are alike and whose answers may be."""
    match = _Match(threshold)
    out: list[tuple[int, int, float]] = []
    for e, x, i, j in _open_pairs(*_both(rows), threshold):
        ok = _reachable(e.a, x.a, i, j, threshold)
        i, j = i[ok], j[ok]
        # Pairs of one earlier question follow one another, so that what is known of it is found once.
        order = np.argsort(i, kind="stable")
        for i, j in zip(i[order].tolist(), j[order].tolist()):
            if (ratio := match.ratio(x.q[j], e.q[i])) >= threshold:
                out.append((int(e.n[i]), int(x.n[j]), ratio))
    return pd.DataFrame(out, columns=["earlier", "later", "q_ratio"])


def _tiles(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tile, side, rows): every row left meets every row right in one tile, of TILE_SIDE rows a side; with `same` the rows left meet one another."""
    parts = [[rows[k : k + TILE_SIDE] for k in range(0, len(rows), TILE_SIDE)] for rows in (left, left if same else right)]
    tile = 0
    for i, x in enumerate(parts[0]):
        for j, y in enumerate(parts[1]):
            if same and j < i:
                continue
            if same and i == j:
                yield tile, 2, x
            else:
                yield tile, 0, x
                yield tile, 1, y
            tile += 1


def _blocks(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(class of the question, class of the answer, blocks) of every cell; there are at most some thousands."""
    found = rows.groupBy("cq", "ca").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lq").cast("long") + F.col("la")).alias("chars")).collect()
    return [(r["cq"], r["ca"], max(-(-r["n"] // BLOCK_ROWS), -(-r["chars"] // BLOCK_CHARS))) for r in found]


def _meetings(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], same: bool) -> list[tuple[int, int, int, int, int]]:
    """(cq, ca, block, meeting, side): the blocks of neighbouring cells meet two by two; side 2 is a block that meets itself."""
    known = {(q, a): n for q, a, n in right}
    out: list[tuple[int, int, int, int, int]] = []
    meeting = 0
    for q, a, n in left:
        for b in range(n):
            for at in ((q + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                for other in range(known.get(at, 0)):
                    if same and (*at, other) < (q, a, b):
                        continue
                    if same and (*at, other) == (q, a, b):
                        out.append((q, a, b, meeting, 2))
                    else:
                        out += [(q, a, b, meeting, 0), (*at, other, meeting, 1)]
                    meeting += 1
    return out


def _alike(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """(earlier, later, q_ratio) by number: pairs whose questions reach the threshold and whose answers may.

    Lengths of a matching pair are in the same or in neighbouring classes, on both sides. The rows of a cell of classes are cut into blocks, and blocks of neighbouring cells
    meet. A task compares two blocks by counts and by their questions. Only rows that have a partner left are sent once more, with their answers, which are compared by
    the runs at their rare characters; of a meeting with many such rows, some at a time. Pairs of rows are not shuffled.
    """
    spark = left.sparkSession
    cells = _blocks(left), _blocks(left if same else right)
    blocks = spark.createDataFrame([(q, a, n, side) for side in (0, 1) for q, a, n in cells[side]], "cq int, ca int, blocks int, of int").coalesce(1)
    met = _meetings(*cells, same)
    meetings = spark.createDataFrame(met, "cq int, ca int, block int, meeting int, side int").coalesce(1)

    def sent(rows: DataFrame, of: int, sides: Sequence[int]) -> DataFrame:
        placed = rows.join(F.broadcast(blocks.filter(F.col("of") == of).drop("of")), ["cq", "ca"])
        placed = placed.withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
        met = F.broadcast(meetings.filter(F.col("side").isin(list(sides))))
        return placed.join(met, ["cq", "ca", "block"]).select("meeting", "side", "n", "q", "lq", "la", "pa")

    rows = sent(left, 0, (0, 1, 2)) if same else sent(left, 0, (0,)).unionByName(sent(right, 1, (1,)))
    parts = min(len(met) // 8 + 1, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    def suspects(rows: pd.DataFrame) -> pd.DataFrame:
        itself = bool((rows["side"] == 2).any())
        found = _suspects(rows, threshold) if itself or rows["side"].nunique() == 2 else ([], [])
        parts = [pd.DataFrame({"tile": tile, "side": side, "n": n}) for tile, side, n in _tiles(*found, itself)]
        if not parts:
            return pd.DataFrame(columns=["meeting", "tile", "side", "n"])
        return pd.concat(parts).assign(meeting=rows["meeting"].iloc[0])[["meeting", "tile", "side", "n"]]

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        return _candidates(rows, threshold)

    near = rows.repartition(parts, "meeting").groupBy("meeting").applyInPandas(suspects, "meeting int, tile int, side int, n long")
    texts = left.select("n", "q", "a", "lq", "la")
    texts = texts if same else texts.unionByName(right.select("n", "q", "a", "lq", "la"))
    again = near.join(texts, "n").repartition(parts, "meeting", "tile")
    return again.groupBy("meeting", "tile").applyInPandas(candidates, "earlier long, later long, q_ratio double")


def _representatives(df: DataFrame, q: str, a: str, pos: str) -> DataFrame:
    """The first row of each distinct pair; copies match it with ratio 1 and need no comparison."""
    first = first_per_key(df.select(pos, q, a), [F.col(q), F.col(a)], [F.col(pos)])
    return first.select(F.col(pos).alias("id"), F.col(q).alias("q"), F.col(a).alias("a"))


def _numbered(reps: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Representatives numbered from 0 in order of their ids, with lengths and classes of length of both sides and the profile of the answer; and how many there are."""
    width = math.log(_span(threshold) * (1 + 1e-6))  # a little wider than lengths may differ

    def size_class(side: str) -> Column:
        return F.floor(F.log(F.greatest(F.length(side), F.lit(1))) / F.lit(width)).cast("int")

    full = F.col("q").isNotNull() & F.col("a").isNotNull()
    # Kept once: the texts are the most of it, and numbers are found from where a row is.
    ordered = cut_lineage(reps.orderBy("id").withColumn("_at", F.monotonically_increasing_id()).select(
        "id", "_at", "q", "a", F.length("q").alias("lq"), F.length("a").alias("la"), size_class("q").alias("cq"), size_class("a").alias("ca"),
        F.when(full, _profile(F.coalesce("a", F.lit("")))).alias("pa"),
    ))
    # The upper bits tell the part, the lower 33 the place in it.
    sizes = {r["part"]: r["n"] for r in ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.lit(starts), F.shiftright("_at", 33).cast("int")) if starts else F.lit(0)
    return ordered.withColumn("n", (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at"), total


def _verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs by number whose answers reach the threshold as well."""
    # Comparing is the heavy step: a fixed number of parts keeps all cores on it however few bytes the pairs take. Not as a filter on a column, which would be
    # evaluated once before the pairs are dealt out and once after.
    parts = 4 * max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    e = reps.select(F.col("n").alias("earlier"), F.col("a").alias("_e"))
    l = reps.select(F.col("n").alias("later"), F.col("a").alias("_l"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = _Match(threshold)
        for rows in batches:
            rows = rows.sort_values("earlier", kind="stable")
            rows["a_ratio"] = np.array([match.ratio(x, y) for x, y in zip(rows["_l"], rows["_e"])], dtype=float)
            yield rows.loc[rows["a_ratio"] >= threshold, ["earlier", "later", "q_ratio", "a_ratio"]]

    both = pairs.join(e, "earlier").join(l, "later").repartition(parts, "earlier", "later")
    return both.mapInPandas(compare, "earlier long, later long, q_ratio double, a_ratio double")


def _comparable(rows: DataFrame) -> DataFrame:
    return rows.filter("id is not null and pa is not null")


def fuzzy_pairs(
    df: DataFrame, threshold: float = 0.9, q: str = "question", a: str = "answer", pos: str = "pos"
) -> DataFrame:
    """(earlier, later, q_ratio, a_ratio) of distinct pairs alike on both sides.

    Exact copies are represented by their first row.
    """
    reps, _ = _numbered(_representatives(df, q, a, pos), threshold)
    rows = _comparable(reps)
    found = cut_lineage(_verified(cut_lineage(_alike(rows, rows, threshold, same=True)), rows, threshold))
    ids = rows.select("n", "id")
    named = found.join(ids.toDF("earlier", "_e"), "earlier").join(ids.toDF("later", "_l"), "later")
    return named.filter("_e < _l").select(F.col("_e").alias("earlier"), F.col("_l").alias("later"), "q_ratio", "a_ratio")


def dedupe_fuzzy(
    df: DataFrame, threshold: float = 0.9, q: str = "question", a: str = "answer", pos: str = "pos",
    crowd: int = 10_000,
) -> DataFrame:
    """Drop every row that is alike, on both sides, to an earlier row that is kept.

    Rows are settled in their order, in stretches that begin with `crowd` rows and double. A stretch is compared with the rows kept before it, and what is left of it
    with itself: of a crowd of near copies only those in one stretch meet two by two, afterwards the crowd is compared with its kept rows alone.
    """
    reps, total = _numbered(_representatives(df, q, a, pos).filter(F.col("q").isNotNull()), threshold)
    rows = _comparable(reps)
    kept: DataFrame | None = None
    start, size = 0, max(crowd, 1)
    while start < total:
        stretch = reps.filter((F.col("n") >= start) & (F.col("n") < start + size))
        if kept is not None:
            known = cut_lineage(_alike(rows.join(kept, "n", "left_semi"), _comparable(stretch), threshold))
            hit = cut_lineage(_verified(known, rows, threshold).select(F.col("later").alias("n")).distinct())
            stretch = cut_lineage(stretch.join(hit, "n", "left_anti"))
        own = _comparable(stretch)
        links = _verified(cut_lineage(_alike(own, own, threshold, same=True)), rows, threshold)
        first = keep_first_unlinked(stretch.select(F.col("n").alias("id")), links).toDF("n")
        kept = first if kept is None else kept.unionByName(first)
        start, size = start + size, 2 * size
    if kept is None:
        return df.limit(0)
    ids = reps.join(kept, "n", "left_semi").select(F.col("id").alias(pos))
    return df.join(ids, pos, "left_semi").select(*df.columns)
