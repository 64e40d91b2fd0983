"""Rule tables: the shipped lists give their labels, large tables and small blocks the labels of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions.common import best_label, first_match
from qaforge.operators import rulebook as RB
from qaforge.rules import lexicons as R


def test_shipped_lists_give_the_same_labels(spark):
    sets = {"intent6": R.INTENT6, "intent4": R.INTENT4, "domain5": R.DOMAIN5, "industry8": R.INDUSTRY8}
    book = RB.compile_rules(RB.rule_table(spark, sets))
    words = sorted({w for rules in sets.values() for ws in rules.values() for w in ws})
    r = random.Random(3)
    texts = [None, "", "nothing"] + [" ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) + r.choice(["", "x"]) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    defaults = {"intent6": "information", "intent4": "information", "domain5": "product", "industry8": "general"}
    low = F.lower("text")
    for mode, fixed in (("best", best_label), ("first", first_match)):
        got = RB.label_by_rules(df, book, mode=mode, defaults=defaults)
        want = {n: fixed(low, sets[n], defaults[n]) for n in sets}
        # A null text has no label in the fixed forms and the default here.
        wrong = got.withColumns({f"w_{n}": c for n, c in want.items()}).filter("text is not null")
        assert wrong.filter(" or ".join(f"not ({n} <=> w_{n})" for n in sets)).count() == 0
    by_text = RB.label_by_rules(df, RB.compile_rules(RB.rule_table(spark, {"c": R.CONTEXTS})), mode="counted", defaults={"c": "general"})
    assert by_text.withColumn("w", L.page_context_counted(F.lit("u"), F.col("text"))).filter("not (c <=> w)").count() == 0


def plain(text, rules, mode):
    """(hits, order) per label by a loop over all rules."""
    low, found = (text or "").lower(), {}
    for word, label in {(k.lower(), (o, lab)) for o, lab, k in rules if k and lab}:
        n = low.count(word) if mode == "counted" else int(word in low)
        if n:
            found[label] = found.get(label, 0) + n
    if mode == "all":
        return [lab for _, lab in sorted(found)]
    if not found:
        return None
    return min(found)[1] if mode == "first" else min(found, key=lambda x: (-found[x], x))[1]


@pytest.mark.parametrize("limit", [1 << 20, 3000])
def test_many_keywords_in_blocks(spark, limit):
    r = random.Random(9)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 7))) for _ in range(400)]
    labels = [(i, f"label{i % 7}") for i in range(7)]
    rules = [(*r.choice(labels), w) for w in words] + [(0, "label0", "ABC"), (0, "label0", "abc"), (1, None, "a"), (2, "label2", None), (2, "label2", "")]
    table = spark.createDataFrame([("s", *x) for x in rules] + [(None, 1, "x", "a")], RB.RULES)
    book = RB.compile_rules(table, limit)
    assert (len(book.blocks) > 3) == (limit == 3000)
    texts = [None, "", "ABCABC é", "aaaa"] + ["".join(r.choice("abcdÉ ") for _ in range(r.randrange(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "id int, text string, s string")
    for mode in ("best", "counted", "first", "all"):
        got = {x.id: x.s for x in RB.label_by_rules(df, book, mode=mode).collect()}
        assert got == {i: plain(t, rules, mode) for i, t in enumerate(texts)}


def test_hundred_thousand_keywords(spark):
    rules = spark.range(100_000).select(F.lit("big").alias("rule_set"), (F.col("id") % 50).cast("int").alias("ord"), F.concat(F.lit("l"), F.col("id") % 50).alias("label"), F.concat(F.lit("key"), F.col("id"), F.lit(".")).alias("keyword"))
    book = RB.compile_rules(rules)
    df = spark.createDataFrame([("key17. key67. key3.",), ("key100000.",), ("xkey99999.x",)], "text string")
    assert [r.big for r in RB.label_by_rules(df, book).collect()] == ["l17", None, "l49"]


def test_empty_table_and_bounds(spark):
    none = spark.createDataFrame([], RB.RULES)
    df = spark.createDataFrame([("x",)], "text string")
    assert RB.label_by_rules(df, RB.compile_rules(none)).columns == ["text"]
    assert [r.hits for r in RB.keyword_hits(df, RB.compile_rules(none)).collect()] == [[]]
    table = RB.rule_table(spark, {"s": {"a": ["one", "two", "three"]}})
    assert RB.label_by_rules(df.limit(0), RB.compile_rules(table)).count() == 0
    with pytest.raises(ValueError):
        RB.compile_rules(table, limit=10, most=2)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_sentiment_keeps_every_row(spark, monkeypatch, rows):
    monkeypatch.setattr(L, "LEXICON_ROWS", rows)
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("the", 0.0)], "token string, valence double")
    texts = [(1, "Good the day"), (1, "bad the"), (None, "good!"), (None, None), (None, "")] + [(i, "the the good") for i in range(10, 40)]
    got = L.sentiment(spark.createDataFrame(texts, "id int, text string"), "text", lexicon, "id").collect()
    want = []
    for i, t in texts:
        v = [{"good": 2.0, "bad": -1.0}.get(w.strip("!"), 0.0) for w in (t or "").lower().split()]
        p, n, u, s = sum(x + 1 for x in v if x > 0), sum(1 - x for x in v if x < 0), sum(1.0 for x in v if x == 0), sum(v)
        total = p + n + u
        want.append((i, *((round(n / total, 3), round(u / total, 3), round(p / total, 3)) if total else (0.0, 1.0, 0.0)), round(s / (s * s + 15) ** 0.5, 4)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_keyword_of_many_labels_is_sent_once(spark):
    """A table that grows by labels of the same keywords keeps its number of blocks nearly: a keyword takes its text once and a number per label."""
    sets = {"s": {f"label number {i:02d}": [f"keyword{k}" for k in range(50)] for i in range(40)}}
    book = RB.compile_rules(RB.rule_table(spark, sets), limit=10_000)
    assert len(book.blocks) == 2
    assert sorted(w for b in book.blocks for w, _ in b) == sorted(f"keyword{k}" for k in range(50))
    df = spark.createDataFrame([("a keyword7 and keyword49",)], "text string")
    assert [len(r["s"]) for r in RB.label_by_rules(df, book, mode="all").collect()] == [40]
