"""Benchmark decontamination by winnowing.

The smallest word-run hash of each sliding window of runs is kept as a fingerprint, on both sides by the same rule, so
any shared span of at least `window` words shares a fingerprint. Documents and benchmark items meet on fingerprints; each
hit is extended to all windows of `window` words around it, and only whole equal windows count. An item shorter than a
window is one window, looked up by its own length.

The benchmark goes out in blocks of bounded size, each broadcast and applied by one pass; documents are never shuffled.
Runs are compared by 64-bit digests of their lower-cased words.

Defined results: a null or wordless text has no words and no hits; repeated rows are judged each; an empty benchmark gives
no hits; items with no words never occur; an item id that appears twice counts once; input columns named like an output
column are replaced; null item ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import LOWER, PLAIN_WORDS, add_columns, arrow_schema, isin_sorted, runs, span_hashes, text_blocks, without, word_spans

RUN, WINDOW = 5, 10  # words in a fingerprint; words in the shortest shared span that is always found
BLOCK_BYTES = 32 << 20  # benchmark text that one broadcast may hold

OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.LongType())),
])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, PLAIN_WORDS)
    return span_hashes(low, starts, ends), row


def winnow(hashes: np.ndarray, row: np.ndarray, run: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept runs (the last smallest of each window), and which window starts lie in one text.

    `hashes` are the digests of all runs of `run` words; `row` is the text of each word.
    """
    spread = window - run + 1
    n = len(row) - window + 1
    if n <= 0:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype=bool)
    whole = row[:n] == row[window - 1 :]
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, spread):
        later = hashes[j : n + j]
        take = later <= best
        best[take] = later[take]
        at[take] = np.flatnonzero(take) + j
    return np.unique(at[whole]), whole


class Index:
    """Fingerprints and windows of one block of items, as sorted hash arrays."""

    def __init__(self, items: list[tuple[int, str]], run: int, window: int):
        self.run, self.window = run, window
        self.ids = np.array([i for i, _ in items], dtype="int64")
        marks, whole, short = [], [], {}
        for low, _, data, offsets in text_blocks(pa.array([t for _, t in items], type=pa.large_string())):
            words, row = _words(data, offsets)
            kept, fits = winnow(runs(words, run), row, run, window)
            marks.append(runs(words, run)[kept])
            whole.append((runs(words, window)[fits], row[: len(fits)][fits] + low))
            length = np.bincount(row, minlength=len(offsets) - 1)
            first = np.cumsum(length) - length
            for size in np.unique(length[(length > 0) & (length < window)]):
                owners = np.flatnonzero(length == size)
                short.setdefault(int(size), []).append((runs(words, int(size))[first[owners]], owners + low))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, dtype="uint64")
        self.windows = {size: _grouped(parts) for size, parts in [(window, whole), *short.items()]}


def _grouped(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the items of each as a slice of one array."""
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype="uint64")
    owners = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype="int64")
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    distinct, begin = np.unique(hashes, return_index=True)
    return distinct, np.append(begin, len(hashes)).astype("int64"), owners


def _hits(index: Index, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window size, window starts in the words, matched hash of that size) of one block of documents."""
    run, window = index.run, index.window
    for size, (distinct, _, _) in index.windows.items():
        n = len(words) - size + 1
        if n <= 0 or not len(distinct):
            continue
        if size == window:
            grams = runs(words, run)
            kept, fits = winnow(grams, row, run, window)
            met = kept[isin_sorted(index.marks, grams[kept]) >= 0]
            starts = np.unique((met[:, None] - np.arange(window - run + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < n)]
            starts = starts[fits[starts]]
        else:
            starts = np.flatnonzero(row[:n] == row[size - 1 :])
        found = isin_sorted(distinct, runs(words, size)[starts])
        yield size, starts[found >= 0], found[found >= 0]


def _spans(first: np.ndarray, last: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
    item = pa.StructArray.from_arrays([pa.array(first, type=pa.int64()), pa.array(last, type=pa.int64())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), item, type=kind)


def _judge(index: Index, texts: pa.Array, before: tuple[pa.Array, pa.Array] | None, schema: pa.Schema) -> list[pa.Array]:
    kinds = [schema.field(f.name).type for f in OUT.fields]
    n_words, n_hit, spans, items = [], [], [], []
    for low, high, data, offsets in text_blocks(texts):
        words, row = _words(data, offsets)
        rows = high - low
        length = np.bincount(row, minlength=rows)
        begin = np.cumsum(length) - length
        edge = np.zeros(len(words) + 1, dtype="int64")
        pairs = []
        if before is not None:
            for i, known in enumerate(before[0][low:high].to_pylist()):
                for s in known:
                    edge[begin[i] + s["first"]] += 1
                    edge[begin[i] + s["last"] + 1] -= 1
        for size, starts, found in _hits(index, words, row):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
            _, slices, owners = index.windows[size]
            # A window counts once per document before its items are looked up.
            both = np.unique(np.stack([row[starts], found], axis=1), axis=0) if len(starts) else np.zeros((0, 2), dtype="int64")
            many = slices[both[:, 1] + 1] - slices[both[:, 1]]
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(both[:, 0], many), index.ids[owners[np.repeat(slices[both[:, 1]], many) + inner]]], axis=1))
        hit = np.cumsum(edge[:-1]) > 0
        opens = hit.copy()
        opens[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        closes = hit.copy()
        closes[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        owner = row[first]
        n_words.append(length)
        n_hit.append(np.bincount(row[hit], minlength=rows))
        spans.append(_spans(first - begin[owner], last - begin[owner], np.bincount(owner, minlength=rows), kinds[2]))
        found_items = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype="int64")
        lists = np.split(found_items[:, 1], np.cumsum(np.bincount(found_items[:, 0], minlength=rows))[:-1])
        if before is not None:
            lists = [np.union1d(a, np.array(b, dtype="int64")) for a, b in zip(lists, before[1][low:high].to_pylist())]
        items.append(pa.array(lists, type=kinds[3]))
    join = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], type=kind)
    whole = lambda parts: pa.array(np.concatenate(parts) if parts else [], type=pa.int64())
    return [whole(n_words), whole(n_hit), join(spans, kinds[2]), join(items, kinds[3])]


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size, sent = [], 0, False
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text)).toLocalIterator():
        if r[0] is None or not r[1]:
            continue
        if block and size + len(r[1]) > limit:
            yield block
            block, size, sent = [], 0, True
        block.append((r[0], r[1]))
        size += len(r[1])
    if block or not sent:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    run: int = RUN, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add `n_words`, `n_hit`, `hit_spans` (word positions, both ends included) and `hit_items` (ids in order) to every document."""
    names = [f.name for f in OUT.fields]
    out = without(docs, names)
    for i, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, run, window))
        schema = T.StructType([f for f in out.schema.fields if f.name not in names] + OUT.fields)
        arrow = arrow_schema(schema)

        def judge(batches: Iterable[pa.RecordBatch], index=index, arrow=arrow, again=i > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = (batch.column("hit_spans"), batch.column("hit_items")) if again else None
                found = _judge(index.value, batch.column(text), before, arrow)
                keep = [batch.column(c) for c in batch.schema.names if c not in names]
                yield pa.RecordBatch.from_arrays([*keep, *found], schema=arrow)

        out = out.mapInArrow(judge, schema)
    return out


def digest(judged: DataFrame, *keep: str) -> DataFrame:
    """Counts and an order-free digest of the items found, one row per document."""
    ids = F.array_join(F.sort_array(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return judged.select(
        *keep, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
