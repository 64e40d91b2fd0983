"""Driver queries of the corpus operators and their SQL twins. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaforge.llm import decontaminate as decon
from qaforge.llm import fingerprints, html, mixing, ngram, periodic, quality, sharding, simhash, tokencount, tokens, trie, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decon.digest(decon.decontaminate(docs, read(spark, sf_dir, "benchmark")), "doc_id")


@query("op3_balanced_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 8)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS bytes FROM d WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM s)) / (bytes / (SELECT sum(bytes) FROM s)) AS rate FROM s),
steps AS (SELECT source, rate, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 24 AS BIGINT))) AS n FROM (SELECT * FROM r UNION ALL SELECT NULL, 1.0)),
cdf AS (SELECT source, rate, n, sum(exp(-rate + n * ln(rate) - CASE WHEN n < 2 THEN 0 ELSE lgamma(n + 1) END)) OVER (PARTITION BY source ORDER BY n) AS p FROM steps),
lists AS (SELECT source, rate, list(p ORDER BY n) AS ps FROM cdf GROUP BY source, rate),
drawn AS (
  SELECT doc_id, d.source, md5(text) AS text_md5, rate,
         len(list_filter(ps, lambda p: p <= ('0x' || substr(md5(concat_ws('|', '10', '1', coalesce(doc_id::VARCHAR, ''), md5(text))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS copies
  FROM d JOIN lists ON d.source IS NOT DISTINCT FROM lists.source)
SELECT doc_id, source, text_md5, round(rate, 9) AS rate, copies::INT AS copies, unnest(range(1, copies + 1))::INT AS copy FROM drawn WHERE copies > 0
"""


@query("op10_poisson_mixture", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources brought to equal shares of the bytes, the corpus to its size of before."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.replicate(docs, mixing.source_rates(docs), seed=10)
    return mixed.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.round("rate", 9).alias("rate"), "copies", "copy")


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.labelled_urls(spark))
    judged = urlfilter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '<(br|/?(p|h1|article|div))>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


@query("op4_main_text", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_chunk_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(read(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize_documents(read(spark, sf_dir, "documents"), byte_bpe())


@query("op5_kneser_ney_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train_and_score(read(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapse_runs(read(spark, sf_dir, "documents"), edit=True))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, bit by bit, lowest first
ids AS (
  SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda s, bit:
         xor(s >> 1, CASE WHEN xor(s, bit) % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT))) % 9 AS h
  FROM (SELECT c, list_transform(range(0, 8 * length(c::VARCHAR)), lambda i: ((ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) % 2)::BIGINT) AS bits
        FROM (SELECT DISTINCT c FROM t))),
rows_ AS (
  SELECT ids.c, 1 AS part, p, r, x FROM ids JOIN t ON t.c = ids.c WHERE p > h
  UNION ALL SELECT ids.c, 0, p, r, x FROM ids JOIN t ON t.c = ids.b WHERE p <= h),
seqs AS (
  SELECT ids.c, coalesce(any_value(s), []) AS s FROM ids LEFT JOIN (SELECT c, list({'r': r, 'x': x} ORDER BY part, p) AS s FROM rows_ GROUP BY c) q ON q.c = ids.c GROUP BY ids.c),
pre AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM seqs),
nodes AS (
  SELECT d, s[1:d] AS k, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(s[d].x)), 0) AS saved,
         max(n) = d AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM pre GROUP BY 1, 2),
sums AS (
  SELECT a, ka, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE d = a + 1) AS n_children
  FROM (SELECT d, saved, leaf, a, k[1:a] AS ka FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes)) GROUP BY a, ka)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, n.ends_sha256 AS ends_sha256
FROM nodes n JOIN sums ON a = n.d AND ka = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(read(spark, sf_dir, "conversations"))
