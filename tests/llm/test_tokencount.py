"""Token counts against the library."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from qaforge.llm import queries, tokencount


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_bpe())


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    None, "", " ", "  ", "\n", " \n x", "don't", "I'll we've they're 'tis ''s x's 's't  't\n't 's\t't O'Reilly's", "a  b\n\n c   d e", "x'rex 'rx 'llx 'l", " 's", "'", "a'",
    "'s", "see <|endoftext|> here<|endoftext|>", "<|endoftext|>", "<|endoftext|>'s 't<|endoftext|> ", "<|endoftext|", "a" * 1000, "ab" * 500, "日本語テキスト" * 300, "\U0001f600" * 50, "é'm'd'x",
    "'" * 50 + "s", "1'm 2're", "...'s", "́a'́", "\x00\x01\x1c\x1d a", "a\x0b'ts \x85't", " x   y　z", " 'll", "\U00010ffff 9",
]


def test_odd_texts(library):
    assert tokencount.merges(queries.byte_bpe()).count(pa.array(ODD)).tolist() == expected(library, ODD)


def test_random_texts(library):
    r = random.Random(11)
    alphabet = "ab1 .'\n\tstmdrevl éß日\U0001f600́  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000), r.randrange(32, 127)])) for _ in range(200)) for _ in range(200)]
    assert tokencount.merges(queries.byte_bpe()).count(pa.array(texts)).tolist() == expected(library, texts)


def test_kinds_of_every_character(library):
    """Each character next to a letter, a digit and a mark, all in a few long texts."""
    counter = tokencount.merges(queries.byte_bpe())
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0 or 0x10000 <= c < 0x13500)]
    texts = ["".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! " for c in codes[k : k + 500]) for k in range(0, len(codes), 500)]
    for text in texts:
        data = np.frombuffer(text.encode(), dtype="uint8")
        starts = tokencount.piece_starts(data, np.array([0, len(data)]), counter.kinds)
        chars = np.cumsum((data & 0xC0) != 0x80) - 1
        assert chars[starts].tolist() == [b for _, (b, _) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_words_and_texts(library):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (95, 96, 97, 500, 60_000)] + ["z" * 70_001, "abc" * 20_000]
    texts = [*words, " ".join(words), " ".join(r.choice(["the", "Ça", "don't", "x9"]) for _ in range(900_000))]
    assert tokencount.merges(queries.byte_bpe()).count(pa.array(texts)).tolist() == expected(library, texts)


def test_segments_join_to_the_text():
    data = np.frombuffer(("word  more\n\nlines " * 500 + "x" * 4000 + " end").encode(), dtype="uint8")
    parts = list(tokencount.segments(data, 300))
    assert len(parts) > 5 and parts[0][0] == 0 and parts[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_equal_digests_do_not_mix(library, monkeypatch):
    """Words that share a digest are told apart by their bytes, within a block and against the words kept."""
    from qaforge.llm import pieces

    plain = pieces.span_hashes
    monkeypatch.setattr(pieces, "span_hashes", lambda *a: plain(*a) & np.uint64(3))
    counter = tokencount.Merges(queries.byte_bpe())
    texts = [t for t in ODD if t][:12] * 2
    for _ in range(2):
        assert counter.count(pa.array(texts)).tolist() == expected(library, texts)


def test_known_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(tokencount, "KNOWN_BYTES", 400)
    counter = tokencount.Merges(queries.byte_bpe())
    texts = [f"some words {i} and more{i}" for i in range(50)]
    for t in texts:
        assert counter.count(pa.array([t])).tolist() == expected(library, [t])
    assert counter.used + 40 * len(counter.known) < 2000


def test_other_files_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencount.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_table(spark, library):
    df = spark.createDataFrame([(i, t, "mine", 3) for i, t in enumerate([*ODD, "over " * 600, "over " * 600])] + [(None, "x", None, None)], "doc_id long, text string, N_TOKENS string, other int")
    rows = tokencount.count_tokens(df.repartition(4), queries.byte_bpe()).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == list(enumerate(expected(library, [*ODD, "over " * 600, "over " * 600])))
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512) and r.__fields__[:3] == ["doc_id", "text", "other"] for r in rows)
    assert tokencount.count_tokens(df.limit(0), queries.byte_bpe()).count() == 0


def test_query_on_all_documents(spark, library):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {d["doc_id"]: n for d, n in zip(table, expected(library, [d["text"] for d in table]))}
