"""Operators against small fixtures and brute force."""

import difflib
import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions import text as T
from qaforge.operators import dedupe as D
from qaforge.operators import prompts as P
from qaforge.operators import ranking
from qaforge.operators import retrieval as RT
from qaforge.operators import tablediff as TD
from qaforge.operators.logs import clean_chat_log, upsert_log
from qaforge.sources import readers, writers
from qaforge.streaming import jobs as J


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text(spark):
    s = F.lit
    assert one(spark, T.clean_text(s("a¶ [1]  b<[2]  "))) == "a   b"
    assert one(spark, T.clean_text_numbered(s("Q1. 3. Is it? Yes. Yes. 4."))) == "Is it? Yes."
    assert one(spark, T.clean_text_numbered(s("Question"))) == "Question"
    assert one(spark, T.clean_text_numbered(s("Question"), compat=True)) == "uestion"
    assert one(spark, T.cut_answer(s("Fine. Is this so? No."), s("zzz"))) == "Fine."
    assert one(spark, T.cut_answer_v2(s("A: zzz again. Short and fine."), s("zzz"))) == "Short and fine."
    assert one(spark, T.expand_contractions(s("I don't, it's Bob's"))) == "I do not, it is Bobs"
    assert one(spark, T.looks_like_question(s("Q1 foo"))) is True
    assert one(spark, T.looks_like_question(s("Isle of"))) is False
    block = "You can use it now\nYou can use it later.\nYou can use it now\n\n- x"
    assert one(spark, T.collapse_redundant(s(block))) == "You can use it now, later.\n\n- x"
    assert one(spark, T.csv_safe_parens(s("a, (b,c), d"))) == "a, (b;c), d"


def test_labels(spark):
    s = F.lit
    assert one(spark, L.intent6(s("zzz"))) == "information"
    assert one(spark, L.intent6(s("buy and pay"))) == "conversion"
    assert one(spark, L.prompt_style(s("ship it"))) == "direct_concise"
    assert one(spark, L.energy(s(""))).asDict() == {"level": "medium", "score": 0}
    assert one(spark, L.energy(s("wow!")))["level"] == "high"
    assert one(spark, L.energy_binary(s("STOP"))) == "high"
    assert one(spark, L.complexity(s("zyx"))) == "low"
    assert one(spark, L.technical_hits(s("API server, Server thread-pool"))) == 3
    kw = F.array(s("product"), s("music"))
    assert one(spark, L.topics(kw)) == ["music", "product", "sales", "support"]
    assert one(spark, L.topics(F.array(s("zzz")), "booking")) == ["booking"]
    assert one(spark, L.personas(F.array(s("zzz")))) == ["helpful assistant"]
    assert one(spark, L.tone(s(0.6), s(-0.2))) == "neutral"


def random_pairs(n, seed):
    rng = random.Random(seed)
    base = ["how do i change the billing address here", "what is the refund policy for yearly plans", "where can i see my orders"]
    rows = []
    for i in range(n):
        q, a = rng.choice(base), rng.choice(base) + " please read the long page about it"
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(q))
            q = q[:k] + rng.choice("abcxyz ") + q[k + rng.randrange(2):]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(a))
            a = a[:k] + rng.choice("abcxyz ") + a[k + 1:]
        rows.append((i, q, a))
    return rows


def test_fuzzy_is_exact(spark):
    rows = random_pairs(150, 3)
    alike = lambda x, y: all(difflib.SequenceMatcher(None, x[c], y[c]).ratio() >= 0.9 for c in (1, 2))
    kept = []
    for r in rows:
        if not any(alike(r, k) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "pos long, question string, answer string").repartition(5)
    assert 1 < len(kept) < 150
    for crowd in (10_000, 2):
        assert sorted(r.pos for r in D.dedupe_fuzzy(df, crowd=crowd).collect()) == [k[0] for k in kept]
    first = {}
    for r in rows:
        first.setdefault(r[1:], r)
    reps = list(first.values())
    pairs = {(r.earlier, r.later) for r in D.fuzzy_pairs(df).collect()}
    assert pairs == {(x[0], y[0]) for x in reps for y in reps if x[0] < y[0] and alike(y, x)}


def test_fuzzy_candidates_stay_few(spark):
    """Texts of the same words share their runs of characters; counts rule out nearly all of their pairs before any text or pair is shuffled."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=25)), " ".join(rng.choices(vocabulary, k=30))) for i in range(200)]
    rows.append((200, rows[7][1] + "s", rows[7][2]))
    df = spark.createDataFrame(rows, "pos long, question string, answer string")
    reps, total = D._numbered(D._representatives(df, "question", "answer", "pos"), 0.9)
    assert total == 201
    found = D._alike(reps, reps, 0.9, same=True).collect()
    assert [(r.earlier, r.later) for r in found] == [(7, 200)]


def test_either_side(spark):
    rng = random.Random(1)
    rows = [(i, "u", f"q{rng.randrange(25)}", f"a{rng.randrange(25)}") for i in range(200)]
    seen_q, seen_a, kept = set(), set(), []
    for i, _, q, a in rows:
        if q not in seen_q and a not in seen_a:
            seen_q.add(q), seen_a.add(a), kept.append(i)
    df = spark.createDataFrame(rows, "pos long, url string, question string, answer string").repartition(7)
    assert sorted(r.pos for r in D.dedupe_either_side(df).collect()) == kept


def test_exact_keeps_first_and_nulls_apart(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A"), (4, "a"), (5, None)], "pos int, q string")
    assert sorted(r.pos for r in D.dedupe_exact(df, D.key_lower(F.col("q"))).collect()) == [1, 2, 3]


def test_row_number_of_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 50 == 0).alias("k"), (F.lit(9) - F.col("id") % 7).alias("v"), "id").repartition(9)
    plain = ranking.row_number_by(df, ["k"], [F.col("v"), F.col("id")])
    spread = ranking.row_number_by(df, ["k"], [F.col("v"), F.col("id")], max_group=10)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


def test_top_k_paths_agree(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "item_id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    want = {(i, r + 1, int(j)) for i in range(60) for r, j in enumerate(np.argsort(-sims[i])[:3])}
    for bound in (100, 0):
        got = RT.top_k(v, v, 3, "item_id", c_id="item_id", skip_self=True, bound=bound, block=16)
        assert {(r.query_id, r["rank"], r.item_id) for r in got.collect()} == want


def test_database_diff(spark):
    emp = [(1, "Al", "HR", "a@x"), (2, "Bo", "IT", "b@x")]
    one_side = {
        "employees": spark.createDataFrame(emp, "id int, name string, dept string, email string"),
        "orders": spark.createDataFrame([(1, 250.75, "Open"), (2, 120.0, "Done")], "order_id int, amount float, status string"),
        "departments": spark.createDataFrame([(1, "HR")], "id int, name string"),
        "products": spark.createDataFrame([(1, "pen")], "id int, name string"),
    }
    two_side = {
        "employees": one_side["employees"].drop("email"),
        "orders": spark.createDataFrame([(1, 250), (2, 120)], "order_id int, amount int").select("order_id", F.col("amount").cast("decimal(10,2)").alias("amount")),
        "products": spark.createDataFrame([(1, "pen"), (2, "ink")], "id int, name string"),
    }
    report = TD.diff_report(one_side, two_side, {"orders": ["order_id"], "employees": ["id"]})
    rows = {(r.table, r.issue, r.column_or_pk, r.details) for r in report.collect()}
    assert ("departments", "Missing in db2", "", "") in rows
    assert ("employees", "Column missing in db2", "email", "string") in rows
    assert ("orders", "Column changed", "amount", "Type: float -> decimal(10,2)") in rows
    assert ("orders", "Content differs", "1", "amount: 250.75 -> 250.00; status: Open -> None") in rows
    assert ("orders", "Content differs", "2", "status: Done -> None") in rows
    assert ("products", "Content row count differs", "", "1 rows in db1 -> 2 rows in db2") in rows
    summary = {r["metric"]: r["count"] for r in TD.diff_summary(report).collect()}
    assert summary == {"Missing Tables": 1, "Missing Columns": 2, "Changed Columns": 1, "Content Differences": 5}
    same = one_side["orders"]
    for mode in ("key", "positional", "multiset"):
        assert TD.diff_rows(same, same, "orders", ["order_id"], mode).isEmpty()


def test_logs(spark):
    log = spark.createDataFrame(
        [(1, "p", "r", None, None), (2, "p", "r", "5", None), (3, "p", "r", None, ""), (4, "p", "r", None, "ok"), (5, "q", "r", None, None), (6, "q", "r", None, None)],
        "seq int, user_prompt string, response string, rating string, rating_msg string",
    )
    assert sorted(r.seq for r in upsert_log(log).collect()) == [4, 5]
    chat = spark.createDataFrame([(1, " p", "r"), (2, "p ", "r"), (3, None, "r"), (4, "x", " Not available in training data.")], "pos int, user_prompt string, response string")
    assert sorted(r.pos for r in clean_chat_log(chat).collect()) == [1, 3]


def test_files(spark, tmp_path):
    path = tmp_path / "qa.jsonl"
    path.write_text('{"question":"q1","answer":"é"}\nbad\n{"question":"q2"}\n', encoding="utf-8")
    got = readers.read_qa(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [("q1", "é"), ("q2", "")]
    assert readers.read_qa(spark, str(path), "keep").filter("_corrupt_record is not null").count() == 1
    rows, bad = readers.tabulate_jsonl(spark, str(path))
    assert rows.count() == 2 and [r.line for r in bad.collect()] == ["bad"]
    writers.write_chat(got, str(tmp_path / "chat"), "s")
    line = spark.read.text(str(tmp_path / "chat")).first()["value"]
    assert json.loads(line)["messages"][2] == {"role": "assistant", "content": "é"}
    assert readers.read_chat(spark, str(tmp_path / "chat")).collect()[0].answer == "q1"
    writers.write_report_csv(spark.createDataFrame([("a,b", None)], "x string, y string"), str(tmp_path / "csv"))
    assert {r.value for r in spark.read.text(str(tmp_path / "csv")).collect()} == {'"x","y"', '"a,b",""'}
    body = b"<urlset><url><loc>http://a/1</loc></url></urlset>"
    (tmp_path / "map.bin").write_bytes(gzip.compress(body))
    assert readers.read_sitemaps(str(tmp_path / "map.bin"), spark).first()["loc"] == "http://a/1"


def test_prompts(spark):
    df = spark.createDataFrame([("api question", "answer words", "technical")], "question string, answer string, context string")
    text = P.system_prompt_for_pair(df, context="context").first()["system_prompt"]
    assert text.startswith("You are a technical expert with a neutral tone. Your expertise is in technical.")
    assert "Tailor language for age group: millennial." in text
    sections = one(spark, P.guideline_sections(F.lit("x\nSafety Rules:\n- a\n\nOther:\n- b\nInstructions:\n- c")))
    assert sections == "Safety Rules:\n- a\n\nOther:\n- b\n\nInstructions:\n- c"
    turns = spark.createDataFrame([(1, t, f"t{t}") for t in range(6)], "c long, t long, x string")
    history = {r.t: r.history for r in P.with_history(turns, "c", "t", "x").collect()}
    assert history[0] == [] and history[1] == ["t0"] and history[5] == ["t2", "t3", "t4"]


def test_stream_upsert_over_two_runs(spark, tmp_path):
    src, table, state = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")
    ddl = "seq int, user_prompt string, response string, rating string, rating_msg string"

    def run(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(src)
        J.stream_log_upsert(spark.readStream.schema(ddl).json(src), table, state).awaitTermination()
        return sorted(r.seq for r in J.latest_log(spark, table).collect())

    assert run([(1, "p", "r", None, None), (2, "q", "r", None, None)]) == [1, 2]
    assert run([(3, "p", "r", "5", None), (4, "q", "r", None, None)]) == [2, 3]


def test_sitemap_chain_is_followed_to_its_end(spark):
    from qaforge.operators import links as K

    rows = [(f"s{i}", "sitemap", 0, f"s{i + 1}") for i in range(40)] + [("s40", "url", 0, "page"), ("s40", "sitemap", 1, "s3")]
    entries = spark.createDataFrame(rows, "sitemap string, kind string, pos long, loc string")
    roots = spark.createDataFrame([("s0", 0)], "sitemap string, pos long")
    got = K.expand_sitemap_index(entries, roots).collect()
    assert [(r.loc, len(r.path)) for r in got] == [("page", 83)]
    with pytest.raises(ValueError, match="nested deeper"):
        K.expand_sitemap_index(entries, roots, max_rounds=20)


def test_zero_vectors_score_zero(spark):
    from qaforge.functions.vectors import cosine

    df = spark.sql("SELECT array(0.0, 0.0) AS a, array(1.0, 0.0) AS b UNION ALL SELECT array(1.0, 0.0), array(1.0, 0.0) UNION ALL SELECT NULL, array(1.0)")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]


def test_damaged_gzip_gives_null(spark, tmp_path):
    import gzip

    from qaforge.sources.readers import read_sitemaps

    body = b"<urlset><url><loc>http://a/1</loc></url></urlset>"
    (tmp_path / "whole.gz").write_bytes(gzip.compress(body))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(body * 50)[:40])
    assert [r.loc for r in read_sitemaps(str(tmp_path), spark).collect()] == ["http://a/1"]


def test_keyed_diff_pairs_repeated_and_null_keys(spark):
    from qaforge.operators import tablediff as TD

    one = spark.createDataFrame([(None, "x"), (1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert TD.diff_rows(one, one, "t", ["k"]).isEmpty()
    assert TD.diff_rows(one, one, "t", (), "positional").isEmpty()
    two = spark.createDataFrame([(None, "y"), (1, "b"), (1, "b"), (1, "a")], "k int, v string")
    got = sorted((r.issue, r.column_or_pk, r.details) for r in TD.diff_rows(one, two, "t", ["k"]).collect())
    assert got == [("Content differs", "", "v: x -> y"), ("Row missing in db1", "1", ""), ("Row missing in db2", "2", "")]


def test_common_in_order_against_a_table():
    import random

    from qaforge.operators.dedupe import common_in_order

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            before = 0
            for j, b in enumerate(y):
                before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
        return row[-1]

    draw = random.Random(3)
    for size in (0, 1, 5, 70, 200):
        for chars in ("ab", "abcdé😀 "):
            x, y = ("".join(draw.choices(chars, k=draw.randint(0, size))) for _ in range(2))
            assert common_in_order(x, y) == plain(x, y)
            assert common_in_order("zz" + x + "q", "zz" + y + "q") == plain("zz" + x + "q", "zz" + y + "q")


def test_stream_log_upsert_rewrites_touched_buckets(spark, tmp_path):
    from qaforge.streaming import jobs as J

    schema = "seq long, user_prompt string, response string, rating string, rating_msg string"
    table, source = str(tmp_path / "log"), str(tmp_path / "in")
    batches = [
        [(1, "a", "x", None, None), (2, "b", "x", None, ""), (3, None, "x", None, None)],
        [(4, "a", "x", "good", None), (5, "c", "y", None, None)],
        [(6, "a", "x", "bad", "why"), (7, "", "x", None, None)],
        [(8, "a", "x", None, None)],
    ]
    files = []
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        J.stream_log_upsert(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "state")).awaitTermination()
        files.append(set(map(str, (tmp_path / "log").rglob("*.parquet"))))
    found = {(r.user_prompt, r.response): (r.seq, r.rating, r.rating_msg) for r in J.latest_log(spark, table).collect()}
    assert found == {("a", "x"): (6, "bad", "why"), ("b", "x"): (2, None, ""), (None, "x"): (3, None, None), ("c", "y"): (5, None, None)}
    assert J.latest_log(spark, table).columns == ["seq", "user_prompt", "response", "rating", "rating_msg"]
    # A batch replaces the files of the buckets of its keys and leaves the others.
    bucket = {k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k[0]), F.lit(k[1])), F.lit(64))).first()[0] for k in (("a", "x"), ("b", "x"))}
    kept = files[1] & files[2]
    assert any(f"{J.BUCKET}={bucket['b', 'x']}/" in f for f in kept) and not any(f"{J.BUCKET}={bucket['a', 'x']}/" in f for f in kept)
    # The last batch run again, as after a failure before its commit, changes nothing.
    before = sorted(map(str, J.latest_log(spark, table).collect()))
    (tmp_path / "state" / "commits" / "3").unlink()
    (tmp_path / "state" / "commits" / ".3.crc").unlink(missing_ok=True)
    J.stream_log_upsert(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(str, J.latest_log(spark, table).collect())) == before
    assert J.latest_log(spark, str(tmp_path / "none")) is None


def test_add_diverse_numbers_its_questions(spark):
    from qaforge.operators import prompts as P

    domains = spark.createDataFrame([("d", "warm")], "domain string, tone string")
    touch = spark.createDataFrame([("t", "i", "about t")], "touchpoint string, intent string, description string")
    platforms = spark.createDataFrame([("p", "calm", "short")], "platform string, tone string, style string")
    asked = spark.createDataFrame([(f"q{i}?",) for i in range(5)] + [("q1?",)], "question string")
    rows = P.add_diverse(200, domains, touch, platforms, asked).collect()
    assert len(rows) == 200 and {r.question for r in rows} == {f"q{i}?" for i in range(5)}
    none = P.add_diverse(3, domains, touch, platforms, asked.limit(0)).collect()
    assert [r.question for r in none] == [None] * 3


def test_an_address_is_taken_once_and_forgotten_in_time(spark, tmp_path):
    """Runs with restarts between them: state lasts over a restart and is dropped when the watermark has passed."""
    import datetime as dt

    schema = "url string, html string, at timestamp"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    html = "<dl><dt>Is {0} here?</dt><dd>Yes, {0} is here.</dd></dl>"

    def run(*pages):
        rows = [(u, html.format(u + str(n)), dt.datetime(2024, 1, day)) for n, (u, day) in enumerate(pages)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = J.stream_pages_to_qa(spark.readStream.schema(schema).parquet(source), out, state, rules=["definition_list"], arrived="at", remember="2 days")
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(r.url for r in spark.read.schema("url string").json(out).collect()), held[-1]

    assert run(("a", 1), ("b", 1), ("a", 1))[0] == ["a", "b"]
    assert run(("a", 2), ("c", 2))[0] == ["a", "b", "c"]
    # Ten days on the old addresses are forgotten: a comes again, and the state holds the new ones only.
    assert run(("d", 12))[0] == ["a", "b", "c", "d"]
    urls, held = run(("a", 13), ("d", 13))
    assert urls == ["a", "a", "b", "c", "d"] and held == 2
    table = spark.createDataFrame([("a", html.format("x")), ("a", html.format("x"))], "url string, html string")
    assert J.pages_to_qa(table, rules=["definition_list"]).count() == 1
