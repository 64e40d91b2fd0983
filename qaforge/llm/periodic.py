"""Maximal periodic runs of words, found with a run-length grammar.

A block of texts becomes one sequence of word numbers with a mark of its own after each text. Recompression turns it into a grammar, level by level: first
every stretch of one repeated symbol becomes one symbol (block compression), then the symbols are split in two halves and every pair of a
symbol of the first half and one of the second becomes one (pair compression); marks are never joined to anything. A symbol's name depends on what it holds and
the cuts depend on the symbols next to them, so equal stretches of words hold equal symbols but for their ends. The longest common extension of two
places climbs as long as both stand at the beginning of a symbol above, jumps over equal symbols (over as many copies at once as both sides have),
and steps down where they differ; it ends at two different words. Extension to the left does the same from the ends of symbols.

Candidates lie on a harmonic grid: a run of period q and at least 2q words holds two neighbouring multiples of q, i and i + q, and the extensions of
(i, i + q) to both sides give all of the run. The grid of a text of n words has about n ln n places. A candidate whose three words on neither side agree is
left out at once, since a run reaches 6 words at least from one side of the grid place to the other. A stretch found with several
periods keeps the smallest, which divides the others.

Defined results: a null text is empty and has no words and no runs; a null id leaves the text as it is where the id decides on an edit; repeated rows are
judged each; a text of any length is judged whole; columns of the input do not reach the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import BLANK_WORDS, arrow_schema, mix, text_blocks, word_spans
from qaforge.llm.pieces import distinct_spans, ragged

LEAST = 12  # words of the shortest run
GRID = 1 << 20  # candidates looked at in one step

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends and smallest periods


@dataclass
class Grammar:
    """All levels one after the other. A place is a symbol's position in these arrays; places of one level are neighbours."""

    symbol: np.ndarray
    size: np.ndarray  # words under it
    up: np.ndarray  # place above that begins here, or -1
    down: np.ndarray  # first place below, or -1 at the lowest level
    up_end: np.ndarray  # place above that ends here, or -1
    down_end: np.ndarray  # last place below, or -1
    ahead: np.ndarray  # equal symbols from here on, this one included
    behind: np.ndarray  # equal symbols up to here


def _repeats(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings of stretches of one symbol, and how many of it are ahead of and behind each place."""
    first = np.flatnonzero(np.diff(symbol, prepend=symbol[0] - 1))
    length = np.diff(first, append=len(symbol))
    inside = np.arange(len(symbol)) - np.repeat(first, length)
    return first, np.repeat(length, length) - inside, inside + 1


def _named(symbol: np.ndarray, second: np.ndarray, joined: np.ndarray, fresh: int) -> np.ndarray:
    """The symbols, those that were joined under new names: one name for each distinct pair of symbol and second."""
    out = symbol.copy()
    if joined.any():
        keys = symbol[joined] * np.int64(1 << 32) + second[joined]
        out[joined] = fresh + np.unique(keys, return_inverse=True)[1]
    return out


def recompress(words: np.ndarray) -> Grammar:
    """Grammar of a sequence of word numbers; negative numbers are marks, each of which stands once."""
    levels: list[dict[str, np.ndarray]] = []
    symbol, size = words.astype("int64"), np.ones(len(words), dtype="int64")
    fresh = int(max(words.max(initial=0), 0)) + 1
    marks = int((words < 0).sum())
    turn = idle = 0
    offset, below = 0, None
    while True:
        first, ahead, behind = _repeats(symbol)
        level = {"symbol": symbol, "size": size, "ahead": ahead, "behind": behind}
        levels.append(level)
        n = len(symbol)
        # Between two marks there is at most one symbol in the end.
        if idle > 40 or n <= 2 * marks + 1 and not ((symbol[1:] >= 0) & (symbol[:-1] >= 0)).any():
            break
        if turn % 2 == 0:
            begin, count = first, ahead[first]
            new = _named(symbol[begin], count, count > 1, fresh)
        else:
            half = (mix(symbol.astype("uint64") + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
            pair = np.zeros(n, dtype=bool)
            pair[:-1] = ~half[:-1] & half[1:] & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
            stays = np.ones(n, dtype=bool)
            stays[1:] = ~pair[:-1]
            begin = np.flatnonzero(stays)
            new = _named(symbol[begin], np.append(symbol, 0)[begin + 1], pair[begin], fresh)
        turn += 1
        if len(begin) == n:
            idle += 1
            levels.pop()
            continue
        idle = 0
        fresh = max(fresh, int(new.max()) + 1)
        end = np.append(begin[1:], n) - 1
        up, up_end = np.full(n, -1, dtype="int64"), np.full(n, -1, dtype="int64")
        up[begin] = up_end[end] = offset + n + np.arange(len(begin))
        level |= {"up": up, "up_end": up_end}
        _link(level, below)
        below = (offset + begin, offset + end)
        total = np.concatenate([[0], np.cumsum(size)])
        size = total[end + 1] - total[begin]
        symbol, offset = new, offset + n
    none = np.full(len(symbol), -1, dtype="int64")
    levels[-1] |= {"up": none, "up_end": none}
    _link(levels[-1], below)
    names = ("symbol", "size", "up", "down", "up_end", "down_end", "ahead", "behind")
    return Grammar(*(np.concatenate([x[k] for x in levels]).astype("int64" if k == "symbol" else "int32") for k in names))


def _link(level: dict[str, np.ndarray], below: tuple[np.ndarray, np.ndarray] | None) -> None:
    none = np.full(len(level["symbol"]), -1, dtype="int64")
    level |= {"down": none, "down_end": none} if below is None else {"down": below[0], "down_end": below[1]}


def extensions(g: Grammar, a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """Words that agree from places a and b of the lowest level on (`left`: up to and with them, backwards)."""
    up, down, equal, way = (g.up_end, g.down_end, g.behind, -1) if left else (g.up, g.down, g.ahead, 1)
    out = np.zeros(len(a), dtype="int64")
    live, a, b = np.arange(len(a)), a.astype("int64"), b.astype("int64")
    while len(live):
        # Climb one level where both places begin a symbol above and that symbol is the same.
        ua, ub = up[a], up[b]
        climbs = (ua >= 0) & (ub >= 0)
        climbs &= g.symbol[ua] == g.symbol[ub]
        same = ~climbs & (g.symbol[a] == g.symbol[b])
        jump = np.where(same, np.minimum(equal[a], equal[b]), 0)
        out[live] += jump * g.size[a].astype("int64")
        lower = ~climbs & ~same
        na = np.where(climbs, ua, np.where(lower, down[a], a + way * jump))
        nb = np.where(climbs, ub, np.where(lower, down[b], b + way * jump))
        on = na >= 0
        live, a, b = live[on], na[on], nb[on]
    return out


def _candidates(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, period) of the harmonic grids of all texts with three agreeing words on a side, about `step` grid places at a time."""
    # Digests of three words; the place before a text's first word is a mark.
    wide = np.concatenate([sequence, [-1, -2]]).astype("uint64")
    three = mix(wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(wide[2:])))
    # A text in which no three words come twice has no run.
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - 2, 0))
    at, _ = ragged(starts, np.maximum(sizes - 2, 0))
    order = np.lexsort((three[at], owner))
    same = (owner[order][1:] == owner[order][:-1]) & (three[at][order][1:] == three[at][order][:-1])
    texts = np.unique(owner[order][1:][same])
    texts = texts[sizes[texts] >= LEAST]
    if not len(texts):
        return
    # A row per text and period, then a place per multiple of the period.
    text, begin = np.repeat(texts, sizes[texts] // 2), np.cumsum(sizes[texts] // 2) - sizes[texts] // 2
    period = np.arange(len(text)) - np.repeat(begin, sizes[texts] // 2) + 1
    count = (sizes[text] - 1) // period
    total = np.cumsum(count)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + step, side="right")))
        q = np.repeat(period[low:high], count[low:high])
        multiple, _ = ragged(np.zeros(high - low, dtype="int64"), count[low:high])
        i = np.repeat(starts[text[low:high]], count[low:high]) + multiple * q
        back = np.maximum(i - 3, 0)
        kept = (three[i] == three[i + q]) | (three[back] == three[np.maximum(i + q - 3, 0)])
        yield i[kept], q[kept]
        low = high


def find_runs(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST, step: int = GRID) -> Runs:
    """Runs of all texts of a sequence: a mark, then each text followed by a mark; `starts` and `sizes` tell where the words of each text stand.

    `least` is 12 or more: candidates are told by three agreeing words.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    found: list[Runs] = []
    grammar = None
    for i, q in _candidates(sequence, starts, sizes, step):
        if not len(i):
            continue
        grammar = grammar or recompress(sequence)
        ahead, behind = extensions(grammar, i, i + q), extensions(grammar, i - 1, i + q - 1, left=True)
        low, high = i - behind, i + q + ahead
        kept = high - low >= np.maximum(least, 2 * q)
        found.append(_smallest(low[kept], high[kept], q[kept]))
    if not found:
        none = np.zeros(0, dtype="int64")
        return none, none, none
    low, high, period = _smallest(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((period, low))
    return low[order], high[order], period[order]


def _smallest(low: np.ndarray, high: np.ndarray, period: np.ndarray) -> Runs:
    """Each stretch once, with its smallest period."""
    order = np.lexsort((period, high, low))
    low, high, period = low[order], high[order], period[order]
    first = np.ones(len(low), dtype=bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[first], high[first], period[first]


def repeated_words(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the stretch that a document of n words is edited to repeat to its end, by its id; None: left as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("text", T.StringType()),
])


def collapse_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: bool = False, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs by start and period, text with each run cut to its first period) of every document.

    Words of the text are joined by one blank. `edit` first makes the documents that `repeated_words` names periodic.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    arrow = arrow_schema(FOUND)

    def block(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        at, end, row = word_spans(data, offsets, BLANK_WORDS)
        k = len(ids)
        sizes = np.bincount(row, minlength=k)
        begin = np.cumsum(sizes) - sizes
        source = np.arange(len(at))
        for i in range(k) if edit else ():
            change = repeated_words(ids[i], int(sizes[i]))
            if change:
                a, p = change
                source[begin[i] + a : begin[i] + sizes[i]] = begin[i] + a + np.arange(sizes[i] - a) % p
        number = distinct_spans(data, at, end)[2] if len(at) else np.zeros(0, dtype="int64")
        # A mark, then each text and its mark.
        sequence = np.empty(len(at) + k + 1, dtype="int64")
        starts = begin + np.arange(k) + 1
        sequence[np.concatenate([[0], starts + sizes])] = -1 - np.arange(k + 1)
        inside, _ = ragged(starts, sizes)
        sequence[inside] = number[source]
        low, high, period = find_runs(sequence, starts, sizes, least)
        of = np.searchsorted(starts, low, side="right") - 1
        # Words after the first period of any run go.
        depth = np.zeros(len(sequence) + 1, dtype="int64")
        np.add.at(depth, low + period, 1)
        np.add.at(depth, high, -1)
        kept = (np.cumsum(depth)[:-1] == 0)[inside]
        word = source[kept]
        left = np.bincount(row[kept], minlength=k)
        spans = end[word] - at[word] + 1
        gather, cuts = ragged(at[word], spans)
        out = np.append(data, 0).astype("uint8")[np.minimum(gather, len(data))]
        out[cuts[1:] - 1] = 32
        edges = cuts[np.concatenate([[0], np.cumsum(left)])]
        # The blank behind a text's last word is not part of it.
        raw, stops = out.tobytes(), (edges[1:] - (left > 0)).tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), stops)]
        lists = np.searchsorted(of, np.arange(k + 1)).astype("int32")
        runs = pa.StructArray.from_arrays([pa.array(low - starts[of]), pa.array(high - low), pa.array(period)], fields=list(arrow.field("runs").type.value_type))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, type=pa.int64()), pa.array(sizes.astype("int64")), pa.ListArray.from_arrays(pa.array(lists), runs).cast(arrow.field("runs").type), pa.array(texts, type=pa.string()),
        ], schema=arrow)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in text_blocks(batch.column(1)):
                yield block(ids[low:high], data, offsets)

    return rows.mapInArrow(judge, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """What the runs come to: their number, the longest (first of equals), and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Greatest length first, then smallest start and period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "text").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
