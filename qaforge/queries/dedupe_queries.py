"""Duplicate removal and chat logs over whole tables."""

from pyspark.sql import functions as F

from qaforge.operators import dedupe as D
from qaforge.operators import logs as G
from qaforge.plans.site_corpus import conversation_pairs
from qaforge.queries.base import DOC_QA_CTE, PAIRS_CTE, WS, doc_qa, query, strip_sql, table


@query(
    "dedupe_exact",
    "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1",
)
def dedupe_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return D.dedupe_exact(docs, D.key_lower(F.col("text")), pos="doc_id")


_squeezed = {c: "lower(" + strip_sql(f"regexp_replace({c}, '{WS}+', ' ', 'g')") + ")" for c in ("question", "answer")}


@query(
    "dedupe_exact_pair",
    f"WITH {DOC_QA_CTE} SELECT pos, question, answer FROM qa QUALIFY row_number() OVER (PARTITION BY {_squeezed['question']}, {_squeezed['answer']} ORDER BY pos DESC) = 1",
)
def dedupe_exact_pair(spark, d):
    qa = doc_qa(spark, d).select("pos", "question", "answer")
    return D.dedupe_exact(qa, D.key_squeezed(F.col("question"), F.col("answer")), keep="last")


@query(
    "dedupe_last_answer",
    f"WITH {DOC_QA_CTE} SELECT site AS page_id, question, min(pos) AS pos, arg_max(answer, pos) AS answer FROM qa GROUP BY ALL",
)
def dedupe_last_answer(spark, d):
    return D.dedupe_last_answer(doc_qa(spark, d).withColumnRenamed("site", "page_id"))


@query(
    "dedupe_first_answer",
    f"""WITH {DOC_QA_CTE}, t AS (SELECT site, {strip_sql('question')} AS question, pos, answer FROM qa)
    SELECT site, question, min(pos) AS pos, {strip_sql('arg_min(answer, pos)')} AS answer FROM t WHERE question <> '' GROUP BY site, question""",
)
def dedupe_first_answer(spark, d):
    return D.dedupe_first_answer(doc_qa(spark, d))


@query("dedupe_either_side")
def dedupe_either_side(spark, d):
    return D.dedupe_either_side(doc_qa(spark, d), scope="site")


def _long_pairs(spark, d):
    """Conversation pairs numbered by conversation, turn and text."""
    pairs = conversation_pairs(table(spark, d, "conversations"))
    return pairs.withColumn("pos", F.struct("conv_id", "turn", "question")).select("pos", "question", "answer")


@query("fuzzy_pairs")
def fuzzy_pairs(spark, d):
    """Documents as pairs of title line and body: near copies of each other."""
    return D.fuzzy_pairs(doc_qa(spark, d)).select(
        "earlier", "later", F.round("q_ratio", 6).alias("q_ratio"), F.round("a_ratio", 6).alias("a_ratio")
    )


@query("dedupe_fuzzy")
def dedupe_fuzzy(spark, d):
    return D.dedupe_fuzzy(doc_qa(spark, d)).select("pos", "question", "answer")


@query("dedupe_fuzzy_conversations")
def dedupe_fuzzy_conversations(spark, d):
    return D.dedupe_fuzzy(_long_pairs(spark, d)).select("pos.conv_id", "pos.turn", "question", "answer")


_LOG = f"""{PAIRS_CTE}, log AS (
    SELECT conv_id * 1000 + turn AS pos, ' ' || question AS user_prompt, CASE WHEN conv_id % 9 = 0 THEN ' Not available in training data. ' ELSE answer END AS response FROM pairs
    UNION ALL SELECT conv_id * 1000 + turn + 500 AS pos, question || ' ' AS user_prompt, answer AS response FROM pairs)"""


@query(
    "clean_chat_log",
    f"""WITH {_LOG}, k AS (SELECT min(pos) AS pos, {strip_sql('user_prompt')} AS p, {strip_sql('response')} AS r FROM log WHERE {strip_sql('response')} <> 'Not available in training data.' GROUP BY ALL)
    SELECT pos, p AS user_prompt, r AS response FROM k""",
)
def clean_chat_log(spark, d):
    pairs = conversation_pairs(table(spark, d, "conversations"))
    key = F.col("conv_id") * 1000 + F.col("turn")
    banned = F.when(F.col("conv_id") % 9 == 0, " Not available in training data. ").otherwise(F.col("answer"))
    log = pairs.select(
        key.alias("pos"), F.concat(F.lit(" "), "question").alias("user_prompt"), banned.alias("response")
    ).unionByName(
        pairs.select(
            (key + 500).alias("pos"), F.concat("question", F.lit(" ")).alias("user_prompt"), F.col("answer").alias("response")
        )
    )
    return G.clean_chat_log(log).select("pos", F.trim("user_prompt").alias("user_prompt"), F.trim("response").alias("response"))


@query(
    "upsert_log",
    """WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS user_prompt, event_type AS response,
      CASE WHEN event_id % 5 = 0 THEN CAST(value AS VARCHAR) END AS rating, CASE WHEN event_id % 7 = 0 THEN props ELSE '' END AS rating_msg FROM events),
    r AS (SELECT *, coalesce(rating, '') <> '' OR coalesce(rating_msg, '') <> '' AS rated FROM e)
    SELECT seq, user_prompt, response, rating_msg FROM r
    QUALIFY row_number() OVER (PARTITION BY user_prompt, response ORDER BY rated DESC, CASE WHEN rated THEN -seq ELSE seq END) = 1""",
)
def upsert_log(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_prompt"), F.col("event_type").alias("response"),
        F.when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).alias("rating"),
        F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise("").alias("rating_msg"),
    )
    return G.upsert_log(log).select("seq", "user_prompt", "response", "rating_msg")
