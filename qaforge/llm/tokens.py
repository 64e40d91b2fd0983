"""Token-id files: each document's ids compressed by itself with a shared zstandard dictionary.

The dictionary is trained on the serialized ids of a bounded sample of documents. Documents are tokenized and compressed where they are
read; only the compressed frames are shuffled, once, into ranges of ids, and each range is written to a file of its own:

    magic, id width, sha256 of the dictionary | frames | index | index offset, documents, magic

The index holds id, place, length and token count per document, so one short document is read without the rest of the file.
A file opens only with the dictionary it was written with.

Text is encoded word by word through a table of known words where that gives the ids of the whole text: byte-level vocabularies cut the text before a single
blank, around a single line break, and between a letter and the marks after it. A text with two white-space characters in a row is encoded whole,
and so is one that holds the string of an added token (`<|endoftext|>`): the library gives that string the token's id, as it does by default.

Defined results: a null text is empty and has the end id only; equal ids follow the order of a hash of the frame; null ids come first and are
marked in the index; repeated rows are stored each; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import BASE, arrow_schema, byte_table, id_cuts, partitions, shared_path, span_hashes, text_blocks, word_spans, written
from qaforge.llm.store import mappable, writing

MAGIC = b"QIDS\x01"
END = 0
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY = 2000, 8 << 20, 64 << 10
CACHE_WORDS = 1_000_000
STEP = 1000  # rows that are encoded before their frames are passed on
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("place", "<u8"), ("length", "<u4"), ("tokens", "<u8")])
HEAD, FOOT = "<5sB32s", "<QQ5s"
MARKS = ".,;:!?#%&*$"
SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
# Empty texts, and white space at either end or twice in a row.
ODD = rf"\A\z|\A{SPACES}|{SPACES}\z|{SPACES}{SPACES}"
WORDS = byte_table([(10, 10), (32, 32)])


class Encoder:
    """Ids of texts as little-endian bytes.

    Words are found and hashed for a block of texts at once. A table from a word's 64-bit digest to its ids grows by the words that are new; the
    library encodes those. A word's digest tells whether it stands at the start of its text, behind a blank or behind a line break.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        """`special_as_text`: strings of special tokens in a text are ordinary text; else they get the token's id, the library's default."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.odd = "|".join([ODD, *map(re.escape, added)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.line_break = self._whole(["\n"])[0]
        self._clear()

    def _clear(self) -> None:
        # Digests in order and the row of each; sorted arrays take a tenth of a dictionary's memory.
        self.keys, self.rows = np.zeros(0, dtype="uint64"), np.zeros(0, dtype="int32")
        self.begin = np.zeros(1 << 16, dtype="int64")
        self.flat = np.zeros(1 << 18, dtype=self.dtype)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _blank_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with a blank before each: encoded as one text and cut where a token opens with the blank."""
        if not words:
            return {}
        ids = np.frombuffer(self._whole([" " + " ".join(words)])[0], dtype=self.dtype)
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(words):
            return dict(zip(words, self._whole([" " + w for w in words])))
        raw, width = ids.tobytes(), self.dtype.itemsize
        ends = np.append(cuts[1:], len(ids)) * width
        return {w: raw[a:b] for w, a, b in zip(words, (cuts * width).tolist(), ends.tolist())}

    def _new(self, words: list[tuple[str, int]]) -> list[bytes]:
        """Ids of words by place: 0 at the start of a text, 1 behind a blank, 2 behind a line break."""
        # Punctuation after a letter is a piece of its own, so such a word is put together from two.
        parts = []
        for word, place in words:
            core = word.rstrip(MARKS)
            cut = len(core) if len(core) < len(word) and core[-1:].isalpha() else len(word)
            parts.append((word[:cut], word[cut:], place))
        blank = self._blank_words(list({core for core, _, place in parts if place == 1}))
        rest = list({x for core, tail, place in parts for x in ((tail,) if place == 1 else (core, tail)) if x})
        plain = dict(zip(rest, self._whole(rest))) | {"": b""}
        return [(blank[core] if place == 1 else (self.line_break if place else b"") + plain[core]) + plain[tail] for core, tail, place in parts]

    def _rows(self, keys: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Rows of the table for distinct digests in order, new words added."""
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if fresh.any():
            new = zip(starts[fresh].tolist(), ends[fresh].tolist(), place[fresh].tolist())
            raw = data.tobytes()
            found = self._new([(raw[i:j].decode("utf-8", "replace"), p) for i, j, p in new])
            ids = np.frombuffer(b"".join(found), dtype=self.dtype)
            sizes = np.fromiter(map(len, found), dtype="int64", count=len(found)) // self.dtype.itemsize
            row = len(self.keys)
            while row + len(found) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[row + 1 : row + 1 + len(found)] = self.used + np.cumsum(sizes)
            self.used += len(ids)
            self.rows = np.insert(self.rows, at[fresh], np.arange(row, row + len(found), dtype="int32"))
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
            at = np.searchsorted(self.keys, keys)
        return self.rows[at].astype("int64")

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        starts, ends, row = word_spans(data, offsets, WORDS)
        before = data[np.maximum(starts - 1, 0)]
        place = np.where(starts == offsets[row], 0, np.where(before == 32, 1, 2)).astype("uint64")
        keys, first, of = np.unique(span_hashes(data, starts, ends) + place * np.uint64(BASE), return_index=True, return_inverse=True)
        rows = self._rows(keys, place[first], starts[first], ends[first], data)[of]
        sizes = self.begin[rows + 1] - self.begin[rows]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begin[rows] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = (total[np.searchsorted(row, np.arange(len(offsets)))] * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow string column without nulls."""
        odd = pc.match_substring_regex(texts, self.odd)
        rest = iter(self._whole(texts.filter(odd).to_pylist()))
        plain: list[bytes] = []
        for _, _, data, offsets in text_blocks(texts.filter(pc.invert(odd))):
            plain += self._block(data, offsets)
        known = iter(plain)
        return [next(rest) if o else next(known) for o in odd.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path, special_as_text=False)


def train_dictionary(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, size: int = DICTIONARY) -> bytes:
    """Dictionary from the ids of the sampled documents (smallest hashes of the id first, up to `SAMPLE_BYTES` of ids)."""
    keys = docs.filter(f"{text} is not null and {text} <> ''").select(F.col(doc_id).cast("long").alias("k")).filter("k is not null")
    picked = [r["k"] for r in keys.orderBy(F.xxhash64("k"), "k").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame([(k,) for k in sorted(set(picked))], "k long")  # `sample` rows at most
    rows = docs.join(F.broadcast(ids), docs[doc_id] == ids["k"], "left_semi").select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    samples, total = [], 0
    for row in rows.toLocalIterator():
        if not row["t"]:
            continue
        ids = encoder(tokenizer).encode(pa.array([row["t"]]))[0]
        samples.append(ids)
        total += len(ids)
        if total >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, dictionary: bytes | None = None, per_task: int = 4
) -> DataFrame:
    """Write the files under `path`; returns the written list of files (part, file, documents, tokens), in id order by part."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = np.array(id_cuts(rows, "doc_id", per_task * n), dtype="int64")
    raw = train_dictionary(rows, tokenizer) if dictionary is None else dictionary
    with writing(f"{path}/dictionary") as f:
        f.write(raw)
    sent = spark.sparkContext.broadcast(raw)
    frames = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("frame", T.BinaryType()),
    ])
    files = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType()),
    ])
    arrow, list_arrow = arrow_schema(frames), arrow_schema(files)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(sent.value), write_checksum=False)
        tail = np.array([end], dtype=coder.dtype).tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                ids = batch.column("doc_id").slice(low, STEP)
                found = [b + tail for b in coder.encode(batch.column("text").slice(low, STEP))]
                part = np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(), side="right").astype("int32") if len(cuts) else np.zeros(len(found), dtype="int32")
                yield pa.RecordBatch.from_arrays([
                    pa.array(part), ids, pa.array([len(b) // coder.dtype.itemsize for b in found], type=pa.int64()), pa.array([pack.compress(b) for b in found], type=pa.binary()),
                ], schema=arrow)

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).dtype.itemsize
        digest = hashlib.sha256(sent.value).digest()

        def sorted_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        rows = sorted_rows()
        row = next(rows, None)
        while row is not None:
            part, file = row[0], f"{path}/part-{row[0]:06d}.ids"
            index, place, tokens = [], struct.calcsize(HEAD), 0
            with writing(file) as f:
                f.write(struct.pack(HEAD, MAGIC, width, digest))
                while row is not None and row[0] == part:
                    f.write(row[3])
                    index.append((row[1] or 0, row[1] is None, place, len(row[3]), row[2]))
                    place, tokens = place + len(row[3]), tokens + row[2]
                    row = next(rows, None)
                f.write(np.array(index, dtype=ENTRY).tobytes())
                f.write(struct.pack(FOOT, place, len(index), MAGIC))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], schema=list_arrow)

    packed = rows.mapInArrow(encode, frames).repartition(n, "part").sortWithinPartitions("part", "doc_id", F.xxhash64("frame"))
    return written(packed.mapInArrow(save, files), "files")


class TokenFile:
    """One file, memory-mapped."""

    def __init__(self, file: str, dictionary: bytes):
        self.data = np.memmap(mappable(file), dtype="uint8", mode="r")
        self.raw = memoryview(self.data)
        magic, width, digest = struct.unpack(HEAD, self.data[: struct.calcsize(HEAD)].tobytes())
        place, count, tail = struct.unpack(FOOT, self.data[-struct.calcsize(FOOT) :].tobytes())
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{file} is not a whole token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.index = self.data[place : place + count * ENTRY.itemsize].view(ENTRY)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        place = int(self.index["place"][i])
        return np.frombuffer(self.unpack.decompress(self.raw[place : place + int(self.index["length"][i])]), dtype=self.dtype)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the document with this id, without reading others."""
        low = int(self.index["null"].sum())
        at = low + int(np.searchsorted(self.index["id"][low:], doc_id))
        return self.ids(at) if at < len(self.index) and self.index["id"][at] == doc_id else None


def read_dictionary(path: str) -> bytes:
    with open(mappable(f"{path}/dictionary"), "rb") as f:
        return f.read()


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_digests(files: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, read back from the files."""
    spark = files.sparkSession
    listed = sorted(files.collect(), key=lambda r: r["part"])  # a row per file
    if not listed:
        return spark.createDataFrame([], READ)
    starts = np.concatenate([[0], np.cumsum([r["tokens"] for r in listed])]).tolist()
    table = spark.createDataFrame([(r["file"], s) for r, s in zip(listed, starts)], "file string, start long").repartition(min(len(listed), partitions(spark)))
    arrow = arrow_schema(READ)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(path)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                stored = TokenFile(file, dictionary)
                counts = stored.index["tokens"].astype("int64")
                before = start + np.cumsum(counts) - counts
                for low in range(0, len(counts), 4096):
                    high = min(len(counts), low + 4096)
                    crc = [zlib.crc32(stored.ids(i).astype("<u4").tobytes()) for i in range(low, high)]
                    part = stored.index[low:high]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part["id"].astype("int64"), mask=part["null"].astype(bool)), pa.array(before[low:high], type=pa.int64()),
                        pa.array(counts[low:high]), pa.array(crc, type=pa.int64()),
                    ], schema=arrow)

    return table.mapInArrow(read, READ)


def tokenize_documents(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = END) -> DataFrame:
    """Write all documents and read them back: (doc_id, start, n_tokens, ids_crc32). Files go under `path`, by default in the shared folder."""
    path = path or shared_path(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, path, tokenizer, end=end), path)
