"""Labels look each word of a text up once."""

import random

from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.rules import lexicons as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_ask_only_words_that_are_cues(spark):
    """Each rule hashed all words of the text anew."""
    cues = [*R.TOPIC_TONES, *R.GENERIC_WORDS, *(c for _, c in R.PERSONA_RULES.values() for c in c)]
    pick = random.Random(5)
    rows = [(i, [pick.choice([*cues, "word", "other"]) for _ in range(pick.randint(0, 6))], pick.choice(["", None, "support"])) for i in range(200)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "i int, k array<string>, c string")
    out = df.select("k", "c", L.topics(F.col("k"), F.col("c")).alias("t"), L.personas(F.col("k"), F.col("c")).alias("p"), L.persona_single(F.col("k"), F.col("c")).alias("s"))
    for r in out.filter("k is not null").collect():
        generic = set(r.k) & set(R.GENERIC_WORDS)
        t = list(dict.fromkeys([x for x in R.TOPIC_TONES if x in r.k] + (list(R.GENERIC_TOPICS) if generic else [])))
        fired = [p for p, (ctx, cue) in R.PERSONA_RULES.items() if (r.c or "") in ctx or set(cue) & set(r.k)]
        p = list(dict.fromkeys(fired + (list(R.GENERIC_PERSONAS) if generic else [])))
        assert list(r.t) == (t or ([r.c] if r.c else ["general"])) and list(r.p) == (p or ["helpful assistant"])
        assert r.s == next((x for x in R.SINGLE_PERSONAS if x in fired), "helpful assistant")
    assert plan(out).count("array_intersect") >= 4


def test_keywords_of_odd_pieces(spark):
    texts = ["!!Word!! two2 ab(cdef) (Ghéij),  next Last", "a" * 50_000 + "1 " + "!" * 50_000 + "1 fine", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(L.keywords(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [["word", "ghéij", "next", "last"], ["fine"], []]
