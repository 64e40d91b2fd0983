"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped sorted hash arrays.

Counting. Tasks sort and count the word pairs of their texts in memory-bounded steps and send the distinct pairs, packed, to
shards by their first word; pairs of frequent first words are spread over all shards by their second one. A shard merges its pairs into
a file of sorted pair digests with counts, and passes on what each word has as a context (tokens, and followers seen once,
twice, more often) and as a follower (tokens, and distinct contexts). Ranges of word digests merge these into files of sorted word
digests. Sums for the discounts come back as one row per range.

Scoring. Workers map the files, look up each token's word and pair, and add up log10 probabilities per text; nothing is
shuffled. Files live in the shared folder, so there is one copy however many executors there are, and no task holds the model.

Words are 48-bit digests, pairs 64-bit ones. Probabilities of the words of the vocabulary and one unknown word add up to one in every context.

Defined results: a null text is empty and is its end token only; with nothing to learn from, every token has probability 1 (the unknown
word is all there is); repeated rows are learnt from each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import BLANK_WORDS, LOWER, arrow_schema, crc_of_id, isin_sorted, mix, partitions, shared_path, span_hashes, text_blocks, word_spans
from qaforge.llm.store import mappable, writing

BITS = 48
BEGIN, END = np.uint64(1), np.uint64(2)  # digests of the two border tokens
STEP_PAIRS = 2_000_000  # pairs that a task counts at once
SHARD_BYTES = 16 << 20  # text per shard
FREQUENT_SAMPLE = 500  # documents that frequent first words are looked for in
MODULUS, HELD_OUT = 7, 2

PAIR_COLUMNS = ("<u8", "<u4")
WORD_COLUMNS = ("<u8", "<u8", "<u8", "<u4", "<u4", "<u4", "<u4")  # word, tokens, tokens as context, contexts, followers seen once, twice, more


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: (token digests with an end token per text, the token before each, the text of each)."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, BLANK_WORDS)
    words = np.maximum(span_hashes(low, starts, ends) >> np.uint64(64 - BITS), np.uint64(3))
    rows = len(offsets) - 1
    last = np.cumsum(np.bincount(row, minlength=rows)) + np.arange(rows)
    cur = np.full(len(words) + rows, END)
    cur[np.arange(len(words)) + row] = words
    text = np.zeros(len(cur), dtype="int64")
    text[last[:-1] + 1] = 1
    before = np.empty_like(cur)
    before[1:] = cur[:-1]
    before[:1] = BEGIN
    before[last[:-1] + 1] = BEGIN
    return cur, before, np.cumsum(text)


def pair_digests(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xA0761D6478BD642F) + second)


def shard_of(first: np.ndarray, second: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    by = np.where(isin_sorted(frequent, first) >= 0, mix(first + second), mix(first))
    return (by % np.uint64(shards)).astype("int64")


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct key tuples in order with the sums of their values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, values
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


def _pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view("uint8").reshape(-1, 8)[:, :size]).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype="uint8")
    out[:, :size] = np.frombuffer(raw, dtype="uint8").reshape(-1, size)
    return out.view("<u8").ravel()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of the first column, which comes in order."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


def _width(values: np.ndarray) -> int:
    """Bytes that each of these counts takes; counts of a very large corpus outgrow four."""
    return 8 if len(values) and values.max() >= 1 << 32 else 4


def _pack_counts(values: list[np.ndarray]) -> bytes:
    flat = np.concatenate(values)
    width = _width(flat)
    return bytes([width]) + flat.astype(f"<u{width}").tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)


def _kinds(kinds: tuple[str, ...], width: int) -> list[str]:
    return [f"<u{width}" if kind == "<u4" else kind for kind in kinds]


def _save(uri: str, columns: list[np.ndarray], kinds: tuple[str, ...]) -> None:
    """Columns one after the other, and a byte that tells the width of the four-byte ones."""
    width = max(_width(c) for c, kind in zip(columns, kinds) if kind == "<u4")
    with writing(uri) as f:
        for column, kind in zip(columns, _kinds(kinds, width)):
            f.write(column.astype(kind).tobytes())
        f.write(bytes([width]))


def _load(uri: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    try:
        data = np.memmap(mappable(uri), dtype="uint8", mode="r")
    except FileNotFoundError:  # no rows, so no file
        return [np.zeros(0, dtype=k) for k in kinds]
    kinds = _kinds(kinds, int(data[-1]))
    n, at, out = (len(data) - 1) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(data[at : at + size].view(kind))
        at += size
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Amounts taken off counts 0, 1, 2 and more, from how many entries have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    # Small tables can give amounts out of range.
    return np.array([0.0, *(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))])


@dataclass
class Model:
    """Where the files are, and the sums that go with them."""

    path: str
    shards: int
    frequent: np.ndarray
    tokens: int  # training tokens
    words: int  # distinct ones
    pairs: int  # distinct pairs
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_often: np.ndarray  # words with one, two, more contexts

    def columns(self, name: str, shard: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """A shard's file, mapped at its first use in this process."""
        known = self.__dict__.setdefault("_mapped", {})
        if (name, shard) not in known:
            known[name, shard] = _load(f"{self.path}/{name}-{shard:06d}", kinds)
        return known[name, shard]

    def words_of(self, h: np.ndarray) -> list[np.ndarray]:
        """Columns of the word table (tokens, tokens as context, contexts, followers once, twice, more); zeros for unknown words."""
        out = [np.zeros(len(h), dtype="float64") for _ in WORD_COLUMNS[1:]]
        share = (h >> np.uint64(BITS - 16)) * np.uint64(self.shards) >> np.uint64(16)
        order = np.argsort(share.astype("uint16"), kind="stable")
        edges = np.searchsorted(share[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[s] : edges[s + 1]]
            stored = self.columns("words", s, WORD_COLUMNS)
            found = isin_sorted(stored[0], h[at])
            known = found >= 0
            at, found = at[known], found[known]
            for column, values in zip(out, stored[1:]):
                column[at] = values[found]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), dtype="float64")
        shard = shard_of(first, second, self.frequent, self.shards)
        digest = pair_digests(first, second)
        order = np.argsort(shard.astype("uint16"), kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[s] : edges[s + 1]]
            stored = self.columns("pairs", s, PAIR_COLUMNS)
            found = isin_sorted(stored[0], digest[at])
            known = found >= 0
            out[at[known]] = stored[1][found[known]]
        return out

    def log_probabilities(self, cur: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the model's probability, log10 of the add-one unigram's, and whether the token is known."""
        # Every token is the one before its follower, so words are looked up once; the begin token is added at the end.
        distinct, of = np.unique(np.append(cur, BEGIN), return_inverse=True)
        count, total, contexts, once, twice, more = self.words_of(distinct)
        spread = self.pairs or 1
        d = self.word_discounts
        rest = (d[1:] @ self.word_often) / spread if self.pairs else 1.0
        low = np.maximum(contexts - d[np.minimum(contexts, 3).astype("int64")], 0) / spread + rest / (self.words + 1)
        e = self.pair_discounts
        left = np.where(total > 0, (e[1] * once + e[2] * twice + e[3] * more) / np.maximum(total, 1), 1.0)
        w = of[:-1]
        u = np.where(before == BEGIN, of[-1], np.concatenate([of[-1:], w[:-1]]))
        seen = self.pair_counts(before, cur)
        p = np.maximum(seen - e[np.minimum(seen, 3).astype("int64")], 0) / np.maximum(total[u], 1) + left[u] * low[w]
        base = (count[w] + 1) / (self.tokens + self.words + 1)
        return np.log10(p), np.log10(base), count[w] > 0


def training_rows(doc_id: str = "doc_id"):
    return crc_of_id(F.col(doc_id)) % MODULUS != HELD_OUT


def _counts(array: np.ndarray) -> list[int]:
    return [int((array == k).sum()) for k in (1, 2, 3, 4)]


def _frequent(docs: DataFrame, shards: int, text: str) -> np.ndarray:
    """First words that would fill over half a shard, by a bounded sample. They decide where pairs go, never what is counted."""
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FREQUENT_SAMPLE)
    rows = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    seen = [np.zeros(0, dtype="uint64")]
    for r in rows.limit(2 * FREQUENT_SAMPLE).toLocalIterator():
        for _, _, data, offsets in text_blocks(pa.array([r["t"]], type=pa.large_string())):
            seen.append(tokens_of(data, offsets)[1])
    words, often = np.unique(np.concatenate(seen), return_counts=True)
    return words[often > often.sum() / (2 * shards)]


def train(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Count all rows into a model under `path`, by default in the shared folder."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "ngram")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    shards = min(1 << max(0, int(max(size // SHARD_BYTES, n - 1)).bit_length()), 1 << 16)
    frequent = _frequent(rows, shards, "text")
    parts = T.StructType([T.StructField("shard", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("firsts", "sizes", "seconds", "counts")])
    sides = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("values", T.BinaryType())])
    sums = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("tokens", "words", "contexts")] + [
        T.StructField("word_counts", T.ArrayType(T.LongType())), T.StructField("word_often", T.ArrayType(T.LongType())), T.StructField("pair_counts", T.ArrayType(T.LongType()))])
    parts_arrow, sides_arrow, sums_arrow = arrow_schema(parts), arrow_schema(sides), arrow_schema(sums)

    def cut(first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
        (first, second), (count,) = _merge([first, second], [np.ones(len(first), dtype="int64")])
        shard = shard_of(first, second, frequent, shards)
        order = np.argsort(shard.astype("uint16"), kind="stable")
        first, second, count, shard = first[order], second[order], count[order], shard[order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[s], edges[s + 1]
            new = np.flatnonzero(np.concatenate([[True], first[a + 1 : b] != first[a : b - 1]]))
            out.append((s, _pack(first[a:b][new], 6), np.diff(np.append(new, b - a)).astype("<u4").tobytes(), _pack(second[a:b], 6), count[a:b].astype("<u4").tobytes()))
        for low in range(0, len(out), 16):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out[low : low + 16]), parts_arrow)], schema=parts_arrow)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                cur, before, _ = tokens_of(data, offsets)
                firsts.append(before)
                seconds.append(cur)
                held += len(cur)
                if held >= STEP_PAIRS:
                    yield from cut(np.concatenate(firsts), np.concatenate(seconds))
                    firsts, seconds, held = [], [], 0
        if held:
            yield from cut(np.concatenate(firsts), np.concatenate(seconds))

    def by_range(kind: int, words: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
        part = ((words >> np.uint64(BITS - 16)) * np.uint64(shards) >> np.uint64(16)).astype("int64")
        edges = np.searchsorted(part, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[s], edges[s + 1]
            yield s, kind, _pack(words[a:b], 6), _pack_counts([v[a:b] for v in values])

    def merge_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, group in _groups(batches):
            first = np.concatenate([np.repeat(_unpack(r[1], 6), np.frombuffer(r[2], dtype="<u4")) for r in group])
            second = np.concatenate([_unpack(r[3], 6) for r in group])
            times = np.concatenate([np.frombuffer(r[4], dtype="<u4") for r in group]).astype("int64")
            del group
            (first, second), (times,) = _merge([first, second], [times])
            digest = pair_digests(first, second)
            order = np.argsort(digest)
            _save(f"{path}/pairs-{s:06d}", [digest[order], times[order]], PAIR_COLUMNS)
            del digest, order
            (context,), values = _merge([first], [times, *((times == k).astype("int64") for k in (1, 2)), (times > 2).astype("int64")])
            rows = list(by_range(0, context, values))
            (word,), values = _merge([second], [times, np.ones(len(times), dtype="int64")])
            rows += by_range(1, word, values)
            rows.append((s, 2, b"", np.array(_counts(times), dtype="<u8").tobytes()))
            for low in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows[low : low + 64]), sides_arrow)], schema=sides_arrow)

    def side(group: list[tuple], kind: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        mine = [r for r in group if r[1] == kind]
        words = np.concatenate([np.zeros(0, dtype="uint64"), *(_unpack(r[2], 6) for r in mine)])
        tables = [_unpack_counts(r[3]).astype("int64").reshape(width, -1) for r in mine]
        values = np.concatenate(tables, axis=1) if tables else np.zeros((width, 0), dtype="int64")
        (words,), values = _merge([words], list(values))
        return words, values

    def merge_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, group in _groups(batches):
            context, (total, once, twice, more) = side(group, 0, 4)
            word, (times, contexts) = side(group, 1, 2)
            every = np.union1d(context, word)
            at = np.searchsorted(every, word), np.searchsorted(every, context)
            columns = [every] + [np.zeros(len(every), dtype="int64") for _ in range(6)]
            for i, where, values in ((1, at[0], times), (2, at[1], total), (3, at[0], contexts), (4, at[1], once), (5, at[1], twice), (6, at[1], more)):
                columns[i][where] = values
            _save(f"{path}/words-{s:06d}", columns, WORD_COLUMNS)
            pairs = sum((np.frombuffer(r[3], dtype="<u8").astype("int64") for r in group if r[1] == 2), np.zeros(4, dtype="int64"))
            often = [int((contexts == 1).sum()), int((contexts == 2).sum()), int((contexts > 2).sum())]
            row = (s, int(times.sum()), len(word), int(contexts.sum()), _counts(contexts), often, pairs.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, sums_arrow)], schema=sums_arrow)

    shuffled = rows.mapInArrow(count, parts).repartition(n, "shard").sortWithinPartitions("shard")
    merged = shuffled.mapInArrow(merge_pairs, sides).repartition(n, "part").sortWithinPartitions("part")
    found = merged.mapInArrow(merge_words, sums).collect()  # a row per range of word digests
    add = lambda name: np.sum([r[name] for r in found], axis=0).tolist() if found else [0] * 4
    total = lambda name: sum(r[name] for r in found)
    return Model(
        path, shards, frequent, total("tokens"), total("words"), total("contexts"), discounts(add("pair_counts")), discounts(add("word_counts")),
        np.array(add("word_often") if found else [0, 0, 0], dtype="float64"),
    )


SCORES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; perplexity is 10 ** (-score / n_tokens)."""
    arrow = arrow_schema(SCORES)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                cur, before, row = tokens_of(data, offsets)
                p, base, known = model.log_probabilities(cur, before)
                rows = high - low
                whole = lambda v: pa.array(np.bincount(row, weights=v, minlength=rows).round().astype("int64"))
                part = lambda v: pa.array(np.bincount(row, weights=v, minlength=rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, rows), whole(None), whole(known), part(base), part(p)], schema=arrow)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCORES)


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out remainder and score all."""
    model = train(docs.filter(training_rows()))
    return score(docs, model).select(
        "doc_id", (~training_rows()).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
