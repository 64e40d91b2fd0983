"""Token counts by merging ragged arrays of symbols in step.

A block of texts is cut into pre-tokens at once; the distinct ones become one flat array of symbols with an offset per sequence. In each round the
rank of every adjacent pair is looked up, every sequence finds the lowest rank it has, all pairs of that rank merge at the same time (from the left where they
overlap), and sequences without a known pair leave with the number of symbols they have left. A pair that a merge makes always has a higher
rank than the merge itself (checked when the file is opened), so merging all places of the lowest rank at once gives what one merge at a time gives.
Long sequences need a round per rank they hold; they are merged by one sweep over the ranks in rising order, each visiting only its own places.

The file is a byte-level BPE in the JSON format of the tokenizers library: words are cut by its standard pattern. A string of an added token inside a text
is that token, as the library has it by default. No begin or end token is counted, and nothing is truncated.

Defined results: a null or empty text has no bytes and no tokens; a text of any length is counted whole, in segments cut where a pre-token must begin;
repeated rows and ids are counted each; columns of the input with the names of the result give way; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qaforge.llm.common import BLOCK, arrow_schema, isin_sorted, text_blocks
from qaforge.llm.pieces import distinct_spans, ragged

OTHER, LETTER, NUMBER, SPACE = range(4)
NEVER = np.int32(2**31 - 1)
LONG = 96  # symbols from which a sequence is merged by the sweep
KNOWN_BYTES = 32 << 20  # counted pre-tokens that a worker keeps
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_kinds(pre_tokenizer) -> np.ndarray:
    """Kind of every code point, as the library's pattern has it.

    Characters that came with different versions of the character tables are asked from the library itself.
    """
    import unicodedata

    import regex

    kinds = np.zeros(0x110000, dtype="uint8")
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    names = {"L": LETTER, "N": NUMBER}
    kinds[every] = [names.get(unicodedata.category(chr(c))[0], OTHER) for c in every.tolist()]
    text = "".join(map(chr, every.tolist()))
    newer = np.zeros(0x110000, dtype="uint8")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            newer[every[m.start() : m.end()]] = kind
    for code in np.flatnonzero(kinds != newer).tolist():
        c = chr(code)
        kinds[code] = LETTER if len(pre_tokenizer.pre_tokenize_str(f"a{c}")) == 1 else NUMBER if len(pre_tokenizer.pre_tokenize_str(f"1{c}")) == 1 else OTHER
    kinds[SPACES] = SPACE
    return kinds


def piece_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte positions at which the pre-tokens of all texts of a block begin."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    code = data[at].astype("int32")
    more = np.flatnonzero(code >= 0xC0)
    if len(more):
        tail = np.concatenate([data, np.zeros(3, dtype="uint8")]).astype("int32") & 0x3F
        p, lead = at[more], code[more]
        two = (lead & 0x1F) << 6 | tail[p + 1]
        three = (lead & 0x0F) << 12 | tail[p + 1] << 6 | tail[p + 2]
        four = (lead & 0x07) << 18 | tail[p + 1] << 12 | tail[p + 2] << 6 | tail[p + 3]
        code[more] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    kind = kinds[code]
    edge = np.zeros(n + 3, dtype=bool)
    edge[np.searchsorted(at, offsets)] = True
    edge[n:] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start[: n + 1])
    low, high = run[:-1], run[1:]
    # White space before a word: its last character stands alone, a blank goes with the word.
    blank = (kind[low] == SPACE) & ~edge[high]
    last = high[blank] - 1
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # An apostrophe by itself takes up to two letters that follow.
    single = low[(high - low == 1) & (code[low] == 0x27) & ~edge[high]]
    single = single[start[single] & (kind[np.minimum(single + 1, n - 1)] == LETTER)]
    if len(single):
        padded = np.concatenate([code, [0, 0]])
        one = padded[single + 1]
        two = np.where(edge[single + 2], 0, padded[single + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        wide = np.isin(one * 256 + np.minimum(two, 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        start[single[short | wide] + 1] = False
        start[single[short] + 2] = True
        start[single[wide] + 3] = True
    return at[np.flatnonzero(start[:n])]


def alternate(hits: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of places in order, where `touches` says that a place overlaps the one before it: every second of each overlapping run."""
    k = np.arange(len(hits))
    first = np.maximum.accumulate(np.where(touches, 0, k))
    return hits[(k - first) % 2 == 0]


def segments(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of one text, each ending before a blank or line break that follows a printing ASCII character; about `limit` bytes each."""
    low, n = 0, len(data)
    while n - low > 2 * limit:
        cut, look = None, low + limit
        while cut is None and look < n:
            window = data[look - 1 : look + limit]
            safe = np.flatnonzero(((window[1:] == 32) | (window[1:] == 10)) & (window[:-1] > 32) & (window[:-1] < 127))
            if len(safe):
                cut = look + int(safe[0])
            look += limit
        if cut is None:
            break
        yield low, cut
        low = cut
    if low < n:
        yield low, n


class Merges:
    """Merge ranks of a vocabulary file, and the counts of pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take white space or whole words only")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
                raise ValueError(f"merge {rank} of {path} comes before a part of it, or makes a known token")
            made[a + b] = rank
        self.size = max(vocab.values(), default=0) + 1
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype="int64") for i in (0, 1))
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks = (left * self.size + right)[order], order.astype("int32")
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype="int32")
        tokenizer = Tokenizer.from_file(path)
        # Bytes are written as printing characters in the vocabulary: those of Latin-1 by themselves, the others from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.bytes = np.array([vocab[names[b]] for b in range(256)], dtype="int32")
        self.kinds = character_kinds(tokenizer.pre_tokenizer)
        self.added = [t["content"] for t in added]
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._clear()

    def _clear(self) -> None:
        self.known, self.counts, self.places = np.zeros(0, dtype="uint64"), np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
        self.sizes, self.store, self.used = np.zeros(0, dtype="int64"), np.zeros(1 << 16, dtype="uint8"), 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = isin_sorted(self.keys, a.astype("int64") * self.size + b)
        return np.where(at >= 0, self.ranks[at], NEVER) if len(self.ranks) else np.full(len(a), NEVER)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence (none is empty); all sequences advance by one rank in a round."""
        left = np.zeros(len(sizes), dtype="int64")
        live, sizes = np.arange(len(sizes)), sizes.copy()
        while len(live):
            begin = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), NEVER, dtype="int32")
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[begin + sizes - 1] = NEVER
            lowest = np.minimum.reduceat(rank, begin)
            done = lowest == NEVER
            if done.any():
                left[live[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, rank = symbols[keep], rank[keep]
                live, sizes, lowest = live[~done], sizes[~done], lowest[~done]
                if not len(live):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hits = alternate(hits, np.diff(hits, prepend=-2) == 1)
            symbols[hits] = self.made[rank[hits]]
            owner = np.repeat(np.arange(len(sizes)), sizes)[hits]
            gone = np.ones(len(symbols), dtype=bool)
            gone[hits + 1] = False
            symbols = symbols[gone]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
        return left

    def sweep(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for long sequences: ranks in rising order, each visiting the places that hold it."""
        n = len(symbols)
        ends = np.cumsum(sizes)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1], before[ends - sizes] = -1, -1
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[following[places] >= 0]
            rank = self.rank(symbols[places], symbols[following[places]])
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, group in zip(rank[cuts].tolist(), np.split(places, cuts[1:])):
                if r != NEVER:
                    if r not in waiting:
                        heapq.heappush(heap, r)
                    waiting.setdefault(r, []).append(group)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            x = np.unique(np.concatenate(waiting.pop(r)))
            x = x[alive[x]]
            x = x[following[x] >= 0]
            x = x[self.rank(symbols[x], symbols[following[x]]) == r]
            if not len(x):
                continue
            x = alternate(x, np.concatenate([[False], following[x[:-1]] == x[1:]]))
            y = following[x]
            symbols[x] = self.made[r]
            alive[y] = False
            after = following[y]
            following[x] = after
            before[after[after >= 0]] = x[after >= 0]
            prior = before[x]
            put(np.unique(np.concatenate([x, prior[prior >= 0]])))
        return np.add.reduceat(alive.astype("int64"), ends - sizes)

    def count_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(starts), dtype="int64")
        sizes = ends - starts
        for long in (False, True):
            picked = np.flatnonzero((sizes >= LONG) == long)
            if len(picked):
                at, _ = ragged(starts[picked], sizes[picked])
                out[picked] = (self.sweep if long else self.merge)(self.bytes[data[at]], sizes[picked])
        return out

    def _counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of a block: distinct ones are looked up among those known, byte by byte, and the others merged."""
        keys, first, of = distinct_spans(data, starts, ends)
        a, b = starts[first], ends[first]
        found = np.zeros(len(keys), dtype="int64")
        at = isin_sorted(self.known, keys)
        fits = np.flatnonzero(at >= 0)
        fits = fits[self.sizes[at[fits]] == (b - a)[fits]]
        mine, begin = ragged(a[fits], (b - a)[fits])
        theirs, _ = ragged(self.places[at[fits]], (b - a)[fits])
        differs = np.flatnonzero(data[mine] != self.store[theirs])
        same = np.ones(len(fits), dtype=bool)
        same[np.searchsorted(begin, differs, side="right") - 1] = False
        fits = fits[same]
        found[fits] = self.counts[at[fits]]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[fits] = False
        fresh = np.flatnonzero(fresh)
        if len(fresh):
            found[fresh] = self.count_pieces(data, a[fresh], b[fresh])
            self._learn(data, keys[fresh], a[fresh], b[fresh], found[fresh])
        return found[of]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        if self.used + 40 * len(self.known) > KNOWN_BYTES:
            self._clear()
        new = np.flatnonzero((isin_sorted(self.known, keys) < 0) & (ends - starts < LONG) & (keys != 0))
        new = new[np.argsort(keys[new], kind="stable")]
        sizes = (ends - starts)[new]
        at, begin = ragged(starts[new], sizes)
        while self.used + len(at) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(at)] = data[at]
        place = np.searchsorted(self.known, keys[new])
        self.known, self.counts = np.insert(self.known, place, keys[new]), np.insert(self.counts, place, counts[new])
        self.places, self.sizes = np.insert(self.places, place, self.used + begin[:-1]), np.insert(self.sizes, place, sizes)
        self.used += len(at)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts = piece_starts(data, offsets, self.kinds)
        if not len(starts):
            return np.zeros(len(offsets) - 1, dtype="int64")
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        return np.bincount(row, weights=self._counts(data, starts, ends), minlength=len(offsets) - 1).astype("int64")

    def _plain(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), dtype="int64")
        for low, high, data, offsets in text_blocks(texts):
            if high - low == 1:
                out[low] = sum(int(self._block(data[a:b], np.array([0, b - a]))[0]) for a, b in segments(data, BLOCK))
            else:
                out[low:high] = self._block(data, offsets)
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow string column; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        if not special.any():
            return self._plain(texts)
        out = np.zeros(len(texts), dtype="int64")
        out[~special] = self._plain(texts.filter(pa.array(~special)))
        for i in np.flatnonzero(special).tolist():
            parts = self.split.split(texts[i].as_py())
            out[i] = len(parts) - 1 + int(self._plain(pa.array(parts, type=pa.large_string())).sum())
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and n_bytes, n_tokens and over_limit of every text, counted where the text is read."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    rows = docs.select(*[f"`{c}`" for c in names], docs[text].alias("_counted"))
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])
    arrow = arrow_schema(schema)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merges(tokenizer)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = counter.count(column)
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, pa.array(found), pa.array(found > limit)], schema=arrow)

    return rows.mapInArrow(add, schema)
