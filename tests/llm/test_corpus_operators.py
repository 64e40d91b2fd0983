"""Corpus operators against plain loops, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from qaforge.llm import common, decontaminate, fingerprints, html, mixing, ngram, quality, queries, sharding, simhash, tokens, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, fp string, rate string, n_words int"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n ", "one", "Two words", "a b c", base, base, " ".join(near), words(40000, 2), "naïve ÇA va\u00a0bien\t x  y", "W7 " * 300, words(200, 5) + "\n\n" + words(9, 6)]
    texts += [words(30 + i, 100 + i) for i in range(40)] + ["hot copy " * 5] * 30
    out = [(i, t, "en", "s0" if i % 3 else f"s{i % 5}", None, 1.0, i, "x", "r", 3) for i, t in enumerate(texts)]
    return [*out, out[6], (None, "no id", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ---------------------------------------------------------------- 1


def test_url_parts_and_rules(spark):
    urls = ["HTTP://Sub.Example.ORG/es/1?x#y", "http://example.org/en/17", "http://a.com/fr/x", "https://b.com/de/", "x.com/de/", None, "", "http://", "http://org", "http://notorg/x", "http://q.com?z=/de/", "a://b://c/d", "http://example.org/en/17"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, host string")
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    got = urlfilter.judge_urls(df, model, queries.URL_RULES).orderBy("page_id").collect()
    for r, u in zip(got, urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(rule), rule, v) for v, rule in queries.URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        assert (r.host, r.path) == (host, path), u
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else ("block" if r.score >= 0.5 else "allow"))
    assert urlfilter.judge_urls(df.limit(0), model).count() == 0


def test_url_model_separates_words_it_was_not_given_together(spark):
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    urls = [("http://casino-bonus.example.net/en/1", 1), ("http://free-pills.example.org/x", 1), ("http://river-museum.example.net/en/1", 0), ("http://city-library.example.com/", 0)]
    got = urlfilter.judge_urls(spark.createDataFrame(urls, "url string, bad int"), model).collect()
    assert all((r.verdict == "block") == bool(r.bad) for r in got)


def test_url_model_reads_the_path(spark):
    labelled = urlfilter.labelled_urls(spark)
    model = urlfilter.train(labelled)
    urls = [
        ("https://example.com/casino/free-pills", 1), ("http://www.example.org/articles/2021/cheap-viagra-pharma.html", 1), ("https://river-museum.co.uk/poker-jackpot", 1),
        ("https://library.edu/a/b/porn/index.php", 1), ("https://docs.example.net/gambling", 1), ("https://harbor.org/torrent-keygen-crack/12", 1),
        ("https://example.com/", 0), ("https://example.com/history/old-town", 0), ("http://www.example.org/articles/2021/garden-weather.html", 0), ("https://river-museum.co.uk/story-library", 0),
        ("https://docs.example.net/roads/map", 0), ("https://blog.unusualname.io/2023/10/qwerty", 0),
    ]
    got = urlfilter.judge_urls(spark.createDataFrame(urls, "url string, bad int"), model).collect()
    assert [r.url for r in got if (r.verdict == "block") != bool(r.bad)] == []
    # An address of the table is bad if either of its parts has a block word.
    parts = {(bool(r.h), bool(r.p)): r.label for r in labelled.select(
        F.col("url").rlike("//[^/]*(casino|viagra)").alias("h"), F.col("url").rlike("//[^/]*/.*(casino|viagra)").alias("p"), "label").distinct().filter("h or p").collect()}
    assert parts == {(True, False): 1.0, (False, True): 1.0, (True, True): 1.0}


def test_long_url(spark):
    """A url of a megabyte costs its length, and its n-grams are those of a plain loop."""
    import time

    model = urlfilter.train(urlfilter.labelled_urls(spark))
    r = random.Random(1)
    path = "/" + "".join(r.choice("abcdefgh/_é") for _ in range(1_000_000))
    df = spark.createDataFrame([("http://h.org" + path,)], "url string")
    start = time.time()
    assert [x.path for x in urlfilter.judge_urls(df, model).collect()] == [path]
    assert time.time() - start < 60
    short = spark.createDataFrame([("http://Ab.org/x1é22",), ("http://a",), ("none",)], "url string")
    host, path = urlfilter.host_and_path(F.col("url"))
    got = [list(x[0]) for x in short.select(urlfilter.grams(host, path)).collect()]

    def plain(text, mark):
        text = f"{mark}{text}$" if text else ""
        return [mark + text[i : i + n] for n in urlfilter.GRAMS for i in range(len(text) - n + 1)]

    assert got == [plain("ab.org", "^") + plain("/x0é0", "~"), plain("a", "^"), []]


# ---------------------------------------------------------------- 2


def test_neighbours(spark, docs, rows):
    got = fingerprints.compare_neighbours(docs).collect()
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in order]
    want = Counter()
    for i, (r, t) in enumerate(zip(order, texts)):
        want[r[0], len(t), hashlib.sha256(fingerprints.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    for r in got:
        assert prints.setdefault(texts[[o[0] for o in order].index(r.doc_id)], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = next(r for r in got if r.doc_id == 9)
    assert 0.6 < long.near_edited < 0.7


def test_chunks_move_only_near_an_edit(none):
    text = words(3000, 9)
    a, b = fingerprints.prints([text.encode(), ("inserted here " + text).encode()])
    assert fingerprints.containment(a, b) > 0.97
    assert fingerprints.prints([b""])[0][0].size == 0
    assert fingerprints.containment(*fingerprints.prints([b"", b""])) == 1.0
    alone = fingerprints.prints([b"x" * 40, text.encode()])[1]
    assert np.array_equal(alone[0], a[0])
    assert fingerprints.compare_neighbours(none).count() == 0
    assert fingerprints.fingerprint(none).count() == 0


# ---------------------------------------------------------------- 3


def test_differencing_is_tight():
    r = random.Random(3)
    sizes = [r.randrange(1, 10_000) for _ in range(500)]
    sums, places = sharding.difference([(0,) * 7 + (s,) for s in sizes])
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 50
    check = [0] * 8
    for s, p in zip(sizes, places):
        check[p[7]] += s
    assert check == sums


@pytest.mark.parametrize("fan", [8, 4096])
def test_shards(spark, docs, rows, fan):
    got = sharding.shard_documents(docs, 8, fan=fan).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    shard_of = {}
    slots = defaultdict(list)
    for r in got:
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard  # copies stay together
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    docs = spark.createDataFrame([(i, "x" * random.Random(i).randrange(1, 5000)) for i in range(400)], "doc_id long, text string")
    sums = Counter()
    for r in sharding.shard_documents(docs, 8).collect():
        sums[r.shard] += r.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < 0.002 * sum(sums.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 4


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><aside>Side</aside><article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text<br>here.<p>Tiny.</p>
    <form><input><button>Send</button></form><div class="ad-box">Buy</div><p>Last &lt;one&gt;</p><div id="comments"><p>Reader says</p></div></article><footer>Foot"""
    assert html.main_text(page) == "Head & line First bold text here. Tiny. Last <one>"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<div><p>" + "long text " * 50 + "</p></div><div class='sidebar'>no</div>") == ("long text " * 50).strip()
    assert html.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    many = html.main_text("<article>" + "<p>para graph</p>" * 5000 + "</article>")
    assert many == " ".join(["para graph"] * 5000)


def test_names_of_article_parts_are_no_reason_to_leave_them_out():
    page = """<div id="page-wrapper"><article><div class="article-header"><h1 class="banner">Title</h1></div><h2 id="In_popular_culture">Popular culture</h2>
    <p class="share-price">Price 12</p><p>Sum <math><mi>x</mi></math> and <label>a label</label> <object>stands in</object></p><div class="header">By me</div>
    <canvas>drawing</canvas> <svg><text>axis</text></svg> <video>no video</video><ul class="feature-list"><li>point</li></ul>
    <div class="share-buttons">Share</div><div class="post sidebar">Side</div><p class="advert">Buy</p><div id="cookieNotice">Cookies</div><section class="user-comments"><p>Said</p></section>
    <ol><li class="comment">Me too</li></ol><form><label>Name</label><select><option>1</option></select></form><div class="site-footer">Foot</div></article></div>"""
    assert html.main_text(page) == "Title Popular culture Price 12 Sum x and a label stands in By me drawing axis no video point"


def test_short_articles_stay_beside_long_ones():
    page = "<body><nav>Menu</nav><article><p>Hi.</p></article><article><p>" + "long text " * 80 + "</p></article><article class='comment'><p>Reader</p></article></body>"
    assert html.main_text(page) == "Hi. " + ("long text " * 80).strip()


@pytest.mark.parametrize("page, text", [
    ("<article>" + "</b>" * 100_000 + "<p>end</p></article>", "end"),
    ("<article>" + "<i>" * 50_000 + "</b>" * 50_000 + "<p>end</p></article>", "end"),
    ("<b><article>" + "<i>" * 50_000 + "</b>" * 50_000 + "<p>end</p></article>", "end"),
    ("<article>" + "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>end</p></article>", "deep end"),
    ("<article>" + "<p>par graph</p>" * 60_000 + "</article>", " ".join(["par graph"] * 60_000)),
])
def test_long_and_deep_pages_take_linear_time(page, text):
    import time

    start = time.time()
    assert html.main_text(page) == text
    assert time.time() - start < 10


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "mine"), (2, None, "<article>ab</article>", "x"), (2, None, "<article>ab</article>", "x")], "page_id int, url string, html string, text string")
    got = html.extract_text(df).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", "", 0), (2, None, "ab", 2), (2, None, "ab", 2)]
    assert html.extract_text(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def test_kneser_ney(spark, docs, rows, none):
    begin, end = b"\0begin", b"\0end"
    split = lambda t: (t or "").encode().lower().split() + [end]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for r in rows:
        if not held(r[0]):
            w = split(r[1])
            one.update(w)
            two.update(zip([begin, *w], w))
    total, contexts, left = Counter(), Counter(b for _, b in two), defaultdict(lambda: [0, 0, 0])
    for (a, _), n in two.items():
        total[a] += n
        left[a][min(n, 3) - 1] += 1
    of = lambda counts: ngram.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])
    d, e, n, v = of(two.values()), of(contexts.values()), sum(one.values()), len(one)
    rest = sum(e[min(c, 3)] for c in contexts.values()) / len(two)
    low = lambda w: max(contexts[w] - e[min(contexts[w], 3)], 0) / len(two) + rest / (v + 1)

    def p(a, w):
        if not total[a]:
            return low(w)
        return max(two[a, w] - d[min(two[a, w], 3)], 0) / total[a] + sum(d[k + 1] * left[a][k] for k in range(3)) / total[a] * low(w)

    assert abs(sum(p(b"w7", w) for w in [*one, b"\0new"]) - 1) < 1e-9
    want = Counter()
    for r in rows:
        w = split(r[1])
        score = sum(math.log10(p(a, b)) for a, b in zip([begin, *w], w))
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        want[r[0], held(r[0]), len(w), sum(one[x] > 0 for x in w), n, round(base, 5), round(score, 5)] += 1
    got = ngram.train_and_score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert ngram.train_and_score(none).count() == 0
    untaught = ngram.score(docs, ngram.train(none)).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in untaught)


# ---------------------------------------------------------------- 6


def test_token_files(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.byte_bpe())
    files = tokens.write_tokens(docs, str(tmp_path / "ids"), queries.byte_bpe())
    got = sorted(tokens.read_digests(files, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted([r[0] is None for r in rows], reverse=True)
    assert [r.doc_id for r in got[1:]] == sorted(r[0] for r in rows if r[0] is not None)
    ids_of = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(i := ids_of(r[1])), zlib.crc32(i.tobytes())) for r in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    raw = tokens.read_dictionary(str(tmp_path / "ids"))
    found = [tokens.TokenFile(r.file, raw).find(9) for r in files.collect()]
    assert any(f is not None and np.array_equal(f, ids_of(rows[9][1])) for f in found)
    with pytest.raises(ValueError, match="another dictionary"):
        tokens.TokenFile(files.first().file, b"other")
    assert tokens.tokenize_documents(none, queries.byte_bpe()).count() == 0


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(queries.byte_bpe()), tokens.Encoder(queries.byte_bpe())
    plain.encode_special_tokens = True
    r = random.Random(6)
    bits = ["a", "It's", "é,", ".", "\n", " ", "  ", "\t", "don't.", "x!!", "###", "naïve***", "<|endoftext|>", "\u00a0", "\u2003", "12.5", "你好", "\x1c", "'s", "A\u0301,"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "", " "]) for _ in range(r.randrange(0, 30))) for _ in range(3000)]
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(pa.array(texts, type=pa.string()))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_get_the_ids_of_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(queries.byte_bpe()), tokens.encoder(queries.byte_bpe())
    r = random.Random(61)
    bits = ["see", "<|endoftext|>", "here", "<|endof", "text|>", "é,", "\n", " ", "."]
    texts = ["see <|endoftext|> here", "a<|endoftext|>b", "<|endoftext|>", "see <|endof text|> here"]
    texts += ["".join(r.choice(bits) + r.choice([" ", ""]) for _ in range(r.randrange(1, 12))) for _ in range(500)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [3826, 220, 50256, 994]
    assert [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(pa.array(texts, type=pa.string()))] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokens.tokenize_documents(docs, queries.byte_bpe(), str(tmp_path / "ids")).orderBy("doc_id").collect()
    assert [(g.n_tokens, g.ids_crc32) for g in got] == [(len(w) + 1, zlib.crc32(np.array([*w, 0], dtype="<u4").tobytes())) for w in want]


# ---------------------------------------------------------------- 7


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(7)
    x = r.random((4000, 4)).astype("float32")
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype("float64")
    model = quality.fit_gam(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert np.allclose(quality.fit_gam(x[:10], np.ones(10)).score(x[:3]), 11 / 12)


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(1, None), (None, 1), (5, 7)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    same = {r.score for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.judge(none, labels).count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


# ---------------------------------------------------------------- 8


def test_simhash(spark, rows):
    r = random.Random(8)
    body = words(400, 80).split()
    texts = [t for _, t, *_ in rows]
    for k in range(150):  # a large group of near copies
        w = list(body)
        for _ in range(k % 4):
            w[r.randrange(400)] = f"new{k}"
        texts.append(" ".join(w))
    table = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, fp int").repartition(6)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(table)

    def mark(t):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    marks = [mark(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for g in got:
        assert g.fp % 2**64 == marks[g.doc_id]
        assert g.component_id == find(g.doc_id)
    kept = simhash.keep_one(docs).collect()
    assert sorted(k.doc_id for k in kept) == sorted({find(i) for i in range(len(texts))})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_ball_lookup_finds_every_link(spark):
    r = random.Random(12)
    centre = r.getrandbits(64)
    marks = [centre]
    for _ in range(300):
        m = centre if r.random() < 0.5 else r.choice(marks)
        for _ in range(r.randrange(6)):
            m ^= 1 << r.randrange(64)
        marks.append(m)
    signed = sorted({m - 2**64 if m >= 2**63 else m for m in marks})
    want = {(b, a) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 4}
    table = spark.createDataFrame([(m, m) for m in signed], "fp long, root long")
    got = {(max(x), min(x)) for x in simhash.ball_links(table).collect()}
    assert got == want and len(want) > 500
    led = {tuple(x) for x in simhash.leader_links(table.select("fp")).collect()}
    assert led <= want


def test_grams():
    from qaforge.session import local_session

    got = local_session(8).sql("select 'ab.c' as h, '/x12/' as p").select(urlfilter.grams(F.col("h"), F.col("p"), (3, 5))).first()[0]
    assert sorted(got) == sorted(["^^ab", "^ab.", "^b.c", "^.c$", "^^ab.c", "^ab.c$", "~~/x", "~/x0", "~x0/", "~0/$", "~~/x0/", "~/x0/$"])


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {g.node: g.root for g in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontaminate(spark, docs, rows, none, limit):
    source = plain_words(rows[9][1])
    items = [(1, " ".join(source[100:115])), (2, " ".join(source[110:119])), (3, "Two, WORDS"), (4, None), (5, "!!!"), (6, " ".join(source[200:210])), (6, " ".join(source[500:512])), (None, "one"), (7, " ".join(["w7"] * 12)), (8, "w1 " + " ".join(source[300:309]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs, bench, block_bytes=limit), "doc_id").collect()
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            if i is not None:
                windows[tuple(w[s : s + k])].add(i)
    want = Counter()
    for r in rows:
        w, hit, met = plain_words(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    met |= windows[tuple(w[s : s + k])]
        want[r[0], len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(tuple(g) for g in got) == want
    assert any(g.n_items > 2 for g in got)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_winnowing_finds_every_long_shared_span():
    r = random.Random(11)
    for _ in range(200):
        shared = [r.randrange(5) for _ in range(10)]
        sides = []
        for _ in range(2):
            w = np.array([r.randrange(5) for _ in range(r.randrange(9))] + shared + [r.randrange(5) for _ in range(r.randrange(9))], dtype="uint64")
            grams = common.runs(w, 5)
            sides.append(set(grams[decontaminate.winnow(grams, np.zeros(len(w), dtype="int64"), 5, 10)[0]].tolist()))
        assert sides[0] & sides[1]


# ---------------------------------------------------------------- 10


def test_replicate(spark, docs, rows, none):
    rates = spark.createDataFrame([("s0", 0.5), ("s1", 0.0), ("s2", 3.0), ("s3", 200.0)], "source string, rate double")
    got = mixing.replicate(docs, rates, seed=4).collect()
    again = mixing.replicate(docs.repartition(3), rates, seed=4).collect()
    assert Counter((g.doc_id, g.copy) for g in got) == Counter((g.doc_id, g.copy) for g in again)
    assert not any(g.source == "s1" for g in got)
    copies = Counter(g.doc_id for g in got if g.source == "s3")
    assert copies and all(130 < n < 270 for i, n in copies.items() if i is not None)
    assert all(1 <= g.copy <= g.copies for g in got)
    assert mixing.replicate(none, rates).count() == 0


def test_rows_without_ids_and_repeated_rows_spread(spark):
    rows = spark.range(20_000, numPartitions=8)
    for text in (F.lit("same"), F.col("id").cast("string")):
        docs = rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), text.alias("text"))
        rates = spark.createDataFrame([("s", 1.0)], "source string, rate double")
        dealt = mixing.replicate(docs, rates, seed=3)
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        copies = dealt.agg(F.sum(F.lit(1))).first()[0]
        assert not copies or len(sizes) == 8 and max(sizes) < 1.3 * copies / 8


def test_counts_are_poisson(spark):
    drawn = spark.range(20000).select(mixing.poisson_count(1, F.lit(1.3), F.col("id")).alias("k")).groupBy("k").count().collect()
    for r in drawn:
        want = 20000 * math.exp(-1.3) * 1.3**r.k / math.factorial(r.k)
        assert abs(r["count"] - want) < 5 * math.sqrt(want) + 5


def test_rates_reach_the_weights(spark, docs, none):
    weights = spark.createDataFrame([("s0", 1.0), ("s2", 3.0)], "source string, weight double")
    rates = {r.source: r for r in mixing.source_rates(docs, weights).collect()}
    assert set(rates) == {"s0", "s2"}
    mixed = {s: r.bytes * r.rate for s, r in rates.items()}
    assert abs(mixed["s2"] / mixed["s0"] - 3) < 1e-9
    assert abs(sum(mixed.values()) - sum(r.bytes for r in rates.values())) < 1e-6
    assert mixing.source_rates(none).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf), name)
        sizes.append(out.count())
        if name != "token_output":
            assert out.columns == docs.columns
            if name != "source_mixing":
                assert out.exceptAll(docs).isEmpty()
            docs = out
    assert sizes[0] < 200 and sizes[0] >= sizes[1] >= sizes[2] > 50 and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_counts_beyond_four_bytes(tmp_path):
    from qaforge.llm import ngram

    big = np.array([1, 2, 7 << 32], dtype="int64")
    for column in (big, big[:2], big[:0]):
        assert ngram._unpack_counts(ngram._pack_counts([column, column])).tolist() == column.tolist() * 2
        keys = np.arange(len(column), dtype="uint64") << np.uint64(60)
        ngram._save(str(tmp_path / "f"), [keys, column], ngram.PAIR_COLUMNS)
        assert [c.tolist() for c in ngram._load(str(tmp_path / "f"), ngram.PAIR_COLUMNS)] == [keys.tolist(), column.tolist()]
    assert [len(c) for c in ngram._load(str(tmp_path / "none"), ngram.WORD_COLUMNS)] == [0] * 7
