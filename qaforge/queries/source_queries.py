"""Round trips: given tables are written by a sink, read back by its reader and compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qaforge.plans.site_corpus import conversation_pairs
from qaforge.queries.base import DOC_QA_CTE, PAIRS_CTE, doc_qa, query, table
from qaforge.session import checkpoint_dir
from qaforge.sources import readers as R
from qaforge.sources import writers as W


def _at(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("qa_file", f"WITH {DOC_QA_CTE} SELECT question, answer FROM qa")
def qa_file(spark, d):
    at = _at(spark, "qa")
    W.write_qa(doc_qa(spark, d), at)
    return R.read_qa(spark, at)


@query("chat_file", f"WITH {PAIRS_CTE} SELECT question, answer FROM pairs WHERE trim(question) <> '' AND trim(answer) <> ''")
def chat_file(spark, d):
    at = _at(spark, "chat")
    W.write_chat(conversation_pairs(table(spark, d, "conversations")), at)
    return R.read_chat(spark, at)


@query(
    "jsonl_table",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS kind, CAST(NULL AS VARCHAR) AS line FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT NULL, NULL, 'no json ' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0""",
)
def jsonl_table(spark, d):
    at = _at(spark, "jsonl")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("kind")))
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("no json "), "o_orderkey")).otherwise(record)
    table(spark, d, "orders").select(line.alias("value")).write.text(at)
    rows, bad = R.tabulate_jsonl(spark, at)
    good = rows.select(F.col("id").cast("long").alias("id"), "kind", F.lit(None).cast("string").alias("line"))
    return good.unionByName(bad.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("kind"), "line"))


@query(
    "url_lists",
    """SELECT DISTINCT 'visited' AS list, trim(url) AS url FROM pages WHERE page_id % 3 <> 0 AND trim(url) <> ''
    UNION ALL SELECT DISTINCT 'failed', trim(url) FROM pages WHERE page_id % 3 = 0 AND trim(url) <> ''""",
)
def url_lists(spark, d):
    at, pages = _at(spark, "urls"), table(spark, d, "pages")
    W.write_url_lists(pages.filter("page_id % 3 <> 0"), pages.filter("page_id % 3 = 0"), f"{at}/visited", f"{at}/failed")
    lists = [R.read_url_list(spark, f"{at}/{name}").select(F.lit(name).alias("list"), "url") for name in ("visited", "failed")]
    return lists[0].unionByName(lists[1])


@query("partitioned_files", "SELECT doc_id, text, lang, source FROM documents")
def partitioned_files(spark, d):
    at = _at(spark, "parts")
    W.write_partitioned(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), at, "source")
    return spark.read.schema("doc_id long, text string, lang string, source string").json(at)


@query(
    "report_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "quoted"' AS c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '' END AS c_mktsegment FROM customer""",
)
def report_csv(spark, d):
    at = _at(spark, "report")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', "quoted"')).alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    W.write_report_csv(rows, at)
    return spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(at)


@query("append_log", "SELECT conv_id, turn, role, text FROM conversations")
def append_log(spark, d):
    at, turns = _at(spark, "log"), table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    W.append_log(turns.filter("conv_id % 2 = 0"), at)
    W.append_log(turns.filter("conv_id % 2 <> 0"), at)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(at)


@query("grouped_by_url_file", f"WITH {DOC_QA_CTE} SELECT site AS url, count(*) AS n, md5(string_agg(question || '|' || answer, '#' ORDER BY pos)) AS pairs FROM qa GROUP BY site")
def grouped_by_url_file(spark, d):
    """A line per address, read back: its pairs in their order."""
    at = _at(spark, "grouped")
    W.write_grouped_by_url(doc_qa(spark, d), at, url="site")
    rows = spark.read.schema("url string, faqs array<struct<Q string, A string>>").json(at)
    return rows.select("url", F.size("faqs").alias("n"), F.md5(F.array_join(F.transform("faqs", lambda x: F.concat(x["Q"], F.lit("|"), x["A"])), "#")).alias("pairs"))


@query(
    "sitemap_files",
    """WITH p AS (SELECT *, page_id % 7 AS f, url || '&b=' || page_id AS u FROM pages)
    SELECT 'map' || f AS sitemap, CASE WHEN f = 6 THEN 'sitemap' ELSE 'url' END AS kind, row_number() OVER (PARTITION BY f ORDER BY page_id) - 1 AS pos, CASE WHEN f = 3 THEN replace(u, '&', '&amp;') ELSE u END AS loc FROM p
    UNION ALL SELECT 'map3', 'url', (SELECT count(*) FROM p WHERE f = 3), 'http://last.example'""",
)
def sitemap_files(spark, d):
    """Sitemaps written as packed files and read back: six lists of pages, one cut off and one broken, and one index. A broken file is read as plain text."""
    at = _at(spark, "sitemaps")
    f = F.col("page_id") % 7
    tag = F.when(f == 6, "sitemap").otherwise("url")
    loc = F.replace(F.concat("url", F.lit("&b="), "page_id"), F.lit("&"), F.lit("&amp;"))
    rows = table(spark, d, "pages").select(f.alias("f"), "page_id", F.concat(F.lit("<"), tag, F.lit("><loc> "), loc, F.lit(" </loc><lastmod>2024</lastmod></"), tag, F.lit(">")).alias("value"))
    root = F.when(F.col("f") == 6, "sitemapindex").otherwise("urlset")
    ends = rows.select("f").distinct()
    start = ends.select("f", F.lit(-1).alias("page_id"), F.concat(F.lit('<?xml version="1.0"?>\n<'), root, F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')).alias("value"))
    broken = F.when(F.col("f") == 3, "<url><loc>http://last.example</loc></link></urlset>").otherwise(F.concat(F.lit("</"), root, F.lit(">")))
    stop = ends.filter("f <> 2").select("f", F.lit(1 << 60).alias("page_id"), broken.alias("value"))
    whole = start.unionByName(rows).unionByName(stop)
    named = whole.withColumn("map", F.concat(F.lit("map"), "f")).repartition("map").sortWithinPartitions("map", "page_id")
    named.select("map", "value").write.partitionBy("map").option("compression", "gzip").text(at)
    return R.read_sitemap_files(spark, at).withColumn("sitemap", F.regexp_extract("sitemap", "map=([^/]+)/", 1))
