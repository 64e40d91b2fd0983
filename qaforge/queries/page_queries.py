"""Links, crawl planning and pair extraction over stored pages."""

from pyspark.sql import functions as F

from qaforge.functions import urls as U
from qaforge.functions.common import fill
from qaforge.operators import dom as D
from qaforge.operators import extract as X
from qaforge.operators import links as K
from qaforge.plans.site_corpus import clean_pairs, site_corpus
from qaforge.queries.base import (
    DOC_QA_CTE, any_sql, clean_sql, cue, cue_sql, doc_qa, lit, query, strip_sql, table,
)
from qaforge.rules import lexicons as R
from qaforge.sources.readers import read_sitemaps
from qaforge.sources.writers import grouped_by_url

# ---------------------------------------------------------------- links

LINKS_CTE = """raw AS (SELECT url AS src, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
  links AS (SELECT src, replace(unnest(l), '&amp;', '&') AS href, unnest(range(len(l))) AS pos FROM raw)"""

# Every link in one of seven forms, so that each way to resolve an address is met.
FORMS = ["{h}", "//cdn.example.com{h}", "?q={h}", "sub{h}#part", "https://other.example.org{h}?y=1#z", "../up{h}", "#only"]
_AUTH = "regexp_extract(src, '^[a-z]+://([^/?#]*)', 1)"
_ROOT = "regexp_extract(src, '^[a-z]+://[^/?#]*')"
_PATH = "regexp_extract(src, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_DIR = f"(CASE WHEN regexp_extract({_PATH}, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_PATH}, '^(.*/)', 1) END)"
_UP = f"(CASE WHEN regexp_extract({_DIR}, '^(.*/)[^/]+/$', 1) = '' THEN '/' ELSE regexp_extract({_DIR}, '^(.*/)[^/]+/$', 1) END)"
RESOLVED_CTE = f"""{LINKS_CTE},
  resolved AS (SELECT src, pos, href, CASE pos % 7
    WHEN 0 THEN {_ROOT} || href
    WHEN 1 THEN regexp_extract(src, '^[a-z]+') || '://cdn.example.com' || href
    WHEN 2 THEN {_ROOT} || {_PATH} || '?q=' || href
    WHEN 3 THEN {_ROOT} || {_DIR} || 'sub' || href
    WHEN 4 THEN 'https://other.example.org' || href || '?y=1'
    WHEN 5 THEN {_ROOT} || {_UP} || 'up' || href
    ELSE regexp_replace(src, '#.*$', '') END AS dst FROM links)"""


def _links(spark, d):
    return K.extract_links(table(spark, d, "pages"))


def _formed(spark, d):
    h, form = F.col("href"), F.col("pos") % len(FORMS)
    out = F
    for i, f in enumerate(FORMS):
        out = out.when(form == i, fill(f, h=h))
    return K.resolve_links(_links(spark, d).withColumn("href", out))


@query("extract_links", f"WITH {LINKS_CTE} SELECT src, href, pos FROM links")
def extract_links(spark, d):
    return _links(spark, d)


@query("normalize_url", f"WITH {RESOLVED_CTE} SELECT src, dst, pos FROM resolved")
def normalize_url(spark, d):
    return _formed(spark, d)


_dst_auth = "regexp_extract(dst, '^[a-z]+://([^/?#]*)', 1)"


@query("same_domain", f"WITH {RESOLVED_CTE} SELECT src, dst, pos FROM resolved WHERE {_dst_auth} = {_AUTH}")
def same_domain(spark, d):
    return K.same_domain(_formed(spark, d))


ENDINGS = ["", ".pdf", ".jpg?x=1", ".JS", "?a=1&utm=2", "/tracking/x", ".svg", ".mp3", "/faq", "/help-desk"]
_ended = f"dst || {cue_sql('pos', ENDINGS, 3)}"


def _ended_links(spark, d):
    return _formed(spark, d).withColumn("dst", F.concat("dst", cue(F.col("pos"), ENDINGS, 3)))


@query(
    "drop_assets",
    f"""WITH {RESOLVED_CTE}, e AS (SELECT src, {_ended} AS dst, pos FROM resolved)
    SELECT src, dst, pos, NOT ({' OR '.join(f"ends_with(dst, {lit(s)})" for s in R.ASSET_SUFFIXES)}) AS suffix_ok FROM e WHERE NOT regexp_matches(dst, {lit(R.ASSET_PATTERN)})""",
)
def drop_assets(spark, d):
    kept = K.drop_assets(_ended_links(spark, d))
    return kept.withColumn("suffix_ok", ~U.is_asset(F.col("dst"), suffix_only=True))


@query(
    "drop_trap_urls",
    f"""WITH {RESOLVED_CTE}, e AS (SELECT src, src || '/' || CASE WHEN pos % 3 = 0 THEN {_AUTH} ELSE 'x' END || href AS dst, pos FROM resolved)
    SELECT src, dst, pos FROM e WHERE NOT contains(substr(dst, length(src) + 1), {_AUTH})""",
)
def drop_trap_urls(spark, d):
    trap = F.when(F.col("pos") % 3 == 0, U.authority(F.col("src"))).otherwise(F.lit("x"))
    return K.drop_trap_urls(_links(spark, d).select("src", F.concat("src", F.lit("/"), trap, "href").alias("dst"), "pos"))


@query(
    "keep_keyword_urls",
    f"WITH {RESOLVED_CTE}, e AS (SELECT src, {_ended} AS dst, pos FROM resolved) SELECT src, dst, pos FROM e WHERE {any_sql('lower(dst)', R.HELP_URL_WORDS)}",
)
def keep_keyword_urls(spark, d):
    return K.keep_keyword_urls(_ended_links(spark, d))


@query(
    "keep_keyword_urls_or_all",
    f"""WITH {RESOLVED_CTE}, h AS (SELECT *, contains(lower(dst), 'no-such-word') AS hit FROM resolved)
    SELECT src, dst, pos FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h)""",
)
def keep_keyword_urls_or_all(spark, d):
    return K.keep_keyword_urls(_formed(spark, d), ["no-such-word"], fallback_all=True)


@query("distinct_links", f"WITH {RESOLVED_CTE} SELECT src, dst, min(pos) AS pos FROM resolved GROUP BY ALL")
def distinct_links(spark, d):
    return K.distinct_links(_formed(spark, d))


@query(
    "page_links",
    f"""WITH {LINKS_CTE}, r AS (SELECT src, regexp_replace({_ROOT} || href, '#.*$', '') AS dst, pos FROM links)
    SELECT src, dst, min(pos) AS pos FROM r
    WHERE NOT regexp_matches(dst, {lit(R.ASSET_PATTERN)}) AND NOT contains(substr(dst, length(src) + 1), {_AUTH}) GROUP BY ALL""",
)
def page_links(spark, d):
    return K.page_links(table(spark, d, "pages"), cues=None)


_site = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[^\\p{L}\\p{N}_]+', '_', 'g')"


@query("site_name", f"SELECT page_id, {_site} AS site, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '_') AS dotted FROM pages")
def site_name(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.site_name(url).alias("site"), U.site_name(url, True).alias("dotted"))


# A link graph from the keys of five tables, with links back up, so that there are cycles.
EDGES_SQL = """edges AS (
    SELECT 'http://shop.example/r/' || n_regionkey AS src, 'http://shop.example/n/' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'http://shop.example/n/' || c_nationkey, 'http://shop.example/c/' || c_custkey FROM customer
    UNION ALL SELECT 'http://shop.example/c/' || o_custkey, 'http://shop.example/o/' || o_orderkey FROM orders
    UNION ALL SELECT 'http://shop.example/c/' || c_custkey, 'http://shop.example/n/' || c_nationkey FROM customer
    UNION ALL SELECT 'http://shop.example/o/' || l_orderkey, 'http://parts.example/p/' || l_partkey FROM lineitem)"""


def _edges(spark, d):
    def page(kind: str, key: str, host: str = "shop.example"):
        return F.concat(F.lit(f"http://{host}/{kind}/"), F.col(key))

    def pairs(name, src, dst):
        return table(spark, d, name).select(src.alias("src"), dst.alias("dst"))

    return (
        pairs("nation", page("r", "n_regionkey"), page("n", "n_nationkey"))
        .unionByName(pairs("customer", page("n", "c_nationkey"), page("c", "c_custkey")))
        .unionByName(pairs("orders", page("c", "o_custkey"), page("o", "o_orderkey")))
        .unionByName(pairs("customer", page("c", "c_custkey"), page("n", "c_nationkey")))
        .unionByName(pairs("lineitem", page("o", "l_orderkey"), page("p", "l_partkey", "parts.example")))
    )


@query(
    "bfs",
    f"""WITH RECURSIVE {EDGES_SQL}, own AS (SELECT DISTINCT src, dst FROM edges WHERE starts_with(dst, 'http://shop.example/')),
    walk AS (SELECT 'http://shop.example/r/' || r_regionkey AS url, 0 AS depth FROM region
      UNION SELECT own.dst, walk.depth + 1 FROM walk JOIN own ON own.src = walk.url WHERE walk.depth < 3)
    SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url""",
)
def bfs(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("http://shop.example/r/"), "r_regionkey").alias("url"))
    return K.bfs(_edges(spark, d), roots, 3)


@query(
    "crawl_report",
    """WITH v AS (SELECT DISTINCT url FROM pages UNION SELECT DISTINCT url || '/missing' FROM pages)
    SELECT v.url, CASE WHEN p.url IS NULL THEN 'failed' ELSE 'visited' END AS status FROM v LEFT JOIN (SELECT DISTINCT url FROM pages) p ON v.url = p.url""",
)
def crawl_report(spark, d):
    pages = table(spark, d, "pages").select("url", F.lit("support").alias("context"))
    visited = pages.select("url").unionByName(pages.select(F.concat("url", F.lit("/missing")).alias("url")))
    pairs = pages.select("url", F.lit(0).alias("pos"), F.col("url").alias("question"), F.col("url").alias("answer"))
    done, failed, _ = K.crawl_report(pages, visited, pairs)
    return done.withColumn("status", F.lit("visited")).unionByName(failed.withColumn("status", F.lit("failed")))


@query(
    "crawl_report_pairs",
    """WITH c AS (SELECT url, min('c' || page_id % 4) AS context FROM pages GROUP BY url)
    SELECT context, p.url, page_id AS pos, 'q' || page_id AS question, p.url AS answer FROM pages p JOIN c ON p.url = c.url WHERE p.url IN (SELECT url FROM pages WHERE page_id % 3 <> 0)""",
)
def crawl_report_pairs(spark, d):
    """The pairs of the visited addresses by the context of their page; every third page was not visited."""
    pages = table(spark, d, "pages")
    pairs = pages.select("url", F.col("page_id").alias("pos"), F.concat(F.lit("q"), "page_id").alias("question"), F.col("url").alias("answer"))
    known = pages.select("url", F.concat(F.lit("c"), F.col("page_id") % 4).alias("context"))
    return K.crawl_report(known, pages.filter("page_id % 3 <> 0").select("url"), pairs)[2]


@query(
    "skip_processed",
    f"""WITH store AS (SELECT DISTINCT {_site} AS s FROM pages WHERE contains(html, ' nicht '))
    SELECT page_id, url FROM pages WHERE {_site} NOT IN (SELECT s FROM store)""",
)
def skip_processed(spark, d):
    pages = table(spark, d, "pages")
    done = pages.filter(F.contains("html", F.lit(" nicht "))).select("url")
    return K.skip_processed(pages.select("page_id", "url"), done, by="site")


@query(
    "robots_sitemaps",
    f"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root FROM pages),
    n AS (SELECT page_id, unnest(CASE WHEN page_id % 2 = 0 THEN [root || '/a.xml', root || '/b.xml'] ELSE [root || '/sitemap.xml', root || '/sitemap_index.xml'] END) AS sitemap, unnest([0, 1]) AS pos FROM b)
    SELECT page_id, sitemap, CAST(pos AS BIGINT) AS pos FROM n""",
)
def robots_sitemaps(spark, d):
    root = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    body = F.when(
        F.col("page_id") % 2 == 0,
        F.concat(F.lit("User-agent: *\nSITEMAP: "), root, F.lit("/a.xml\nDisallow:\nSitemap:"), root, F.lit("/b.xml\r\n")),
    ).otherwise("User-agent: *")
    # The page number is kept in the fragment, which is no part of a site.
    site = F.concat("url", F.lit("#"), "page_id").alias("site")
    out = K.robots_sitemaps(table(spark, d, "pages").select(site, body.alias("body")))
    return out.select(F.regexp_extract("site", r"#(\d+)$", 1).cast("long").alias("page_id"), "sitemap", "pos")


@query(
    "read_sitemaps",
    """SELECT 'http://shop.example/o/' || o_orderkey AS sitemap, 'url' AS kind, CAST(i AS BIGINT) AS pos,
      CASE i WHEN 0 THEN 'http://shop.example/c/' || o_custkey || '?a=1&b=2' ELSE 'http://shop.example/p/' || o_orderpriority END AS loc
    FROM orders, (SELECT unnest([0, 1]) AS i)""",
)
def read_sitemaps_query(spark, d):
    body = fill(
        '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        "<url><loc> http://shop.example/c/{c}?a=1&amp;b=2 </loc></url><url><loc>http://shop.example/p/{p}</loc></url></urlset>",
        c=F.col("o_custkey"), p=F.col("o_orderpriority"),
    )
    orders = table(spark, d, "orders").select(F.concat(F.lit("http://shop.example/o/"), "o_orderkey").alias("sitemap"), body.alias("body"))
    return read_sitemaps(orders)


@query(
    "expand_sitemap_index",
    """SELECT 'http://shop.example/c/' || c_custkey AS loc FROM customer
    UNION SELECT 'http://shop.example/s/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT 'http://shop.example/e/' || n_nationkey FROM nation""",
)
def expand_sitemap_index(spark, d):
    def page(kind, key):
        return F.concat(F.lit(f"http://shop.example/{kind}/"), F.col(key))

    def entries(name, sitemap, kind, pos, loc):
        return table(spark, d, name).select(
            sitemap.alias("sitemap"), F.lit(kind).alias("kind"), F.col(pos).cast("long").alias("pos"), loc.alias("loc")
        )

    rows = (
        entries("nation", page("r", "n_regionkey"), "sitemap", "n_nationkey", page("n", "n_nationkey"))
        .unionByName(entries("customer", page("n", "c_nationkey"), "url", "c_custkey", page("c", "c_custkey")))
        .unionByName(entries("supplier", page("n", "s_nationkey"), "url", "s_suppkey", page("s", "s_suppkey")))
        .unionByName(entries("nation", page("n", "n_nationkey"), "sitemap", "n_regionkey", page("r", "n_regionkey")))
        # A chain: each nation's own sitemap names the next one's, and a page.
        .unionByName(entries("nation", page("d", "n_nationkey"), "sitemap", "n_nationkey", F.concat(F.lit("http://shop.example/d/"), F.col("n_nationkey") + 1)))
        .unionByName(entries("nation", page("d", "n_nationkey"), "url", "n_nationkey", page("e", "n_nationkey")))
    )
    roots = table(spark, d, "region").select(page("r", "r_regionkey").alias("sitemap"), F.col("r_regionkey").alias("pos"))
    roots = roots.unionByName(roots.select(F.replace("sitemap", F.lit("/r/"), F.lit("/d/")).alias("sitemap"), "pos").filter("pos = 0"))
    return K.expand_sitemap_index(rows, roots).select("loc")


# ---------------------------------------------------------------- pages as elements


@query(
    "dom_nodes",
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""",
)
def dom_nodes(spark, d):
    nodes = D.dom_nodes(table(spark, d, "pages"))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _without_sql(x: str, tags) -> str:
    """A page's markup without comments and without the given elements, which close themselves in the stored pages."""
    out = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        out = f"regexp_replace({out}, '(?s)<{tag}( [^>]*)?>.*?</{tag}>', '', 'g')"
    return out


def _runs_sql(x: str) -> str:
    """Texts between tags, decoded and stripped, as one line."""
    runs = f"list_transform(string_split(regexp_replace({x}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda r: {strip_sql('r')})"
    out = f"array_to_string(list_filter({runs}, lambda r: r <> ''), ' ')"
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{mark}', '{char}')"
    return out


@query("drop_noise_text", f"SELECT page_id, {_runs_sql(_without_sql('html', ['head', 'script', 'style', 'nav', 'footer', 'div']))} AS text FROM pages")
def drop_noise_text(spark, d):
    """What is left of the stored pages without their noisy elements: the text of all remaining runs."""
    clean = D.drop_noise(D.page_dom(table(spark, d, "pages")), R.NOISE_TAGS_WIDE, exact_ids=["none"], classes=["ad"])
    return clean.select("page_id", F.array_join(F.filter(F.col("pieces")["text"], lambda t: t.isNotNull() & (t != "")), " ").alias("text"))


@query("drop_noise")
def drop_noise(spark, d):
    clean = D.drop_noise(D.page_dom(table(spark, d, "pages")), R.NOISE_TAGS_WIDE, R.NOISE_NAMES, R.NOISE_NAMES)
    return D.dom_nodes(clean).select("page_id", "node_id", "tag", "text")


@query("page_text", f"SELECT page_id, {_runs_sql(_without_sql('html', ['script', 'style', 'nav', 'footer', 'h1']))} AS text FROM pages")
def page_text(spark, d):
    return D.page_text(D.page_dom(table(spark, d, "pages"))).select("page_id", "text")


@query("page_prefilter", f"SELECT page_id FROM pages WHERE {any_sql('lower(html)', ['nicht', 'question', 'ention', 'q:'])}")
def page_prefilter(spark, d):
    return X.page_prefilter(table(spark, d, "pages"), ["nicht", "question", "ention", "q:"]).select("page_id")


# ---------------------------------------------------------------- pair rules on pages written from the documents

_q, _a = clean_sql("question"), clean_sql("answer")


def _escaped(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _written(spark, d, markup: str):
    """One page per document: its first line and the rest inside the given markup."""
    qa = doc_qa(spark, d)
    html = fill("<html><body><nav><p>menu?</p></nav>" + markup + "</body></html>", q=_escaped(F.col("question")), a=_escaped(F.col("answer")))
    return qa.select(F.col("pos").alias("page_id"), F.concat(F.lit("http://docs.example/"), "pos").alias("url"), html.alias("html"))


def _rule(name: str, markup: str, expr, q_sql: str = _q, a_sql: str = _a, where: str = "q <> '' AND a <> ''", noise: bool = True):
    sql = f"WITH {DOC_QA_CTE}, t AS (SELECT pos AS page_id, {q_sql} AS q, {a_sql} AS a FROM qa) SELECT page_id, q AS question, a AS answer FROM t WHERE {where}"

    @query(name, sql)
    def run(spark, d):
        dom = D.page_dom(_written(spark, d, markup))
        dom = D.drop_noise(dom) if noise else dom
        return X.qa_rule(dom, expr()).select("page_id", "question", "answer")

    return run


_asks = f"(CASE WHEN {_q} = '' THEN '' ELSE {_q} END || '?')"
_rule("qa_definition_list", "<dl><dt>{q}</dt><dt>lone</dt></dl><dl><dt>{q}</dt><p>x</p><dd>{a}</dd></dl>", X.definition_list)
_rule("qa_details", "<details><summary>{q}</summary><p>{a}</p><ul><li>more</li></ul></details>", X.details, a_sql=f"({_a} || ' more')", where="q <> ''")
_rule("qa_details_first", "<details><summary>{q}</summary><b>no</b><p>{a}</p><p>more</p></details>", lambda: X.details(content="first"))
_rule("qa_heading_next", "<h2>{q}?</h2><b>skip</b><div>{a}</div><p>no</p>", X.heading_next, q_sql=f"{clean_sql('''(question || '?')''')}")
_rule(
    "qa_heading_section", "<h3>{q}?</h3><p>{a}</p><b>skip</b><ul><li>end</li></ul><h3>plain</h3><p>no</p>", X.heading_section,
    q_sql=f"{clean_sql('''(question || '?')''')}", a_sql=clean_sql("(answer || ' end')"),
)
_rule(
    "qa_heading_find_next_p", "<div><h2>{q} faq</h2></div><section><p>{a}</p></section>", X.heading_find_next_p,
    q_sql=strip_sql("(question || ' faq')"), a_sql=strip_sql("answer"), where="true",
)
_rule("qa_accordion", '<div class="Accordion-box"><div><h4>{q}</h4></div><section>{a}</section></div>', lambda: X.accordion("any"), q_sql=_q, a_sql=_q, where="q <> ''")
_rule(
    "qa_accordion_expandable",
    '<div class="itemExpander_module_expandableSection__x"><h3>{q}</h3><div class="itemExpander_module_expandableSectionContent__y">{a}</div></div>',
    lambda: X.accordion("expandable"), where="q <> '' AND a <> ''",
)
_rule(
    "qa_table_rows", "<table><tr><td>{q}?</td><td>{a}</td></tr><tr><td>{q}?</td><td>x</td><td>y</td></tr></table>", X.table_rows,
    q_sql=clean_sql("(question || '?')"),
)
_rule(
    "qa_microdata",
    '<div itemscope itemtype="https://schema.org/FAQPage"><div itemprop="mainEntity"><b itemprop="name">{q}</b><div itemprop="acceptedAnswer"><i>{a}</i></div></div></div>',
    X.microdata, q_sql=strip_sql("question"), a_sql=strip_sql("answer"), where="true",
)
_rule("qa_topic_grid", '<div class="row lb-grid"><strong>{q}</strong><div><p>{a}</p></div><h3>end</h3></div>', X.topic_grid,
      a_sql=f"trim({_a} || ' ' || {_a})", where="q <> '' AND a <> ''")
_rule(
    "qa_container", '<section id="my-FAQ"><h4>two {q}</h4><span>{a}</span></section>', X.container,
    q_sql=strip_sql("('two ' || question)"), a_sql=strip_sql("answer"), where=f"a <> '' AND len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) >= 2",
)
_rule(
    "qa_block_sequence", "<p>Q: {q}</p><li>A: {a}</li><p>tail</p>", X.block_sequence,
    q_sql=f"regexp_replace({clean_sql('''('Q: ' || question)''')}, '(?i)^\\s*q[:\\-]\\s*', '')",
    a_sql=f"regexp_replace({clean_sql('''('A: ' || answer)''')}, '(?i)^\\s*a[:\\-]\\s*', '') || ' tail'", where="q <> ''",
)
_rule(
    "qa_prefix_sequence", "<p>Q: {q}</p><li>A: {a}</li><p>skip me</p><b>also this</b>", X.prefix_sequence,
    q_sql=strip_sql(f"replace({clean_sql('''('Q: ' || question)''')}, 'Q:', '')"),
    a_sql=strip_sql(f"replace({clean_sql('''('A: ' || answer || ' also this')''')}, 'A:', '')"),
    where="length(q) > 3 AND length(a) > 3",
)


def _ld_page(spark, d):
    item = F.struct(
        F.lit("Question").alias("@type"), F.col("question").alias("name"),
        F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text")).alias("acceptedAnswer"),
    )
    doc = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(F.lit("FAQPage")).alias("@type"), F.array(item).alias("mainEntity")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), doc, F.lit("</script></head><body></body></html>"))
    return doc_qa(spark, d).select(F.col("pos").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))


@query(
    "qa_jsonld",
    f"WITH {DOC_QA_CTE}, t AS (SELECT pos AS page_id, {strip_sql('question')} AS question, {strip_sql('answer')} AS answer FROM qa) SELECT * FROM t WHERE question <> '' AND answer <> ''",
)
def qa_jsonld(spark, d):
    return X.qa_rule(D.page_dom(_ld_page(spark, d)), "jsonld").select("page_id", "question", "answer")


# Letters that could start a question or an answer line are replaced, so that the only ones are those written here.
_plain_q, _plain_a = (f"regexp_replace('x' || {c}, '[QqAa]', 'e', 'g')" for c in ("question", "answer"))


@query(
    "qa_text_regex",
    f"""WITH {DOC_QA_CTE}, p AS (SELECT pos AS page_id, {_plain_q} AS q, {_plain_a} AS a FROM qa),
    t AS (SELECT page_id, 0 AS i, {clean_sql('q')} AS question, {clean_sql('a')} AS answer FROM p
      UNION ALL SELECT page_id, 1 AS i, 'lest' AS question, {clean_sql('q')} AS answer FROM p)
    SELECT page_id, question, answer FROM t WHERE question <> '' AND answer <> ''""",
)
def qa_text_regex(spark, d):
    q, a = (F.regexp_replace(F.concat(F.lit("x"), c), "[QqAa]", "e") for c in ("question", "answer"))
    text = fill("Q: {q}\nA: {a}\nQ: lest\nA: {q}", q=q, a=a)
    pairs = doc_qa(spark, d).select(F.col("pos").alias("page_id"), F.explode(X.text_regex(text)).alias("p"))
    return pairs.select("page_id", "p.question", "p.answer")


@query(
    "qa_block_pairs",
    f"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    b AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM t),
    c AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN line || '?' ELSE 'A: ' || line END AS line FROM b),
    g AS (SELECT *, i // 3 AS grp FROM c),
    p AS (SELECT doc_id, grp * 3 AS pos, max(CASE WHEN i % 3 = 0 THEN line END) AS question,
      string_agg(CASE WHEN i % 3 <> 0 THEN regexp_replace(line, '(?i)^\\s*a[:\\-]\\s*', '') END, ' ' ORDER BY i) AS answer FROM g GROUP BY doc_id, grp)
    SELECT doc_id, pos, regexp_replace(question, '(?i)^\\s*q[:\\-]\\s*', '') AS question, answer FROM p WHERE answer IS NOT NULL""",
)
def qa_block_pairs(spark, d):
    blocks = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(i.alias("pos"), F.when(i % 3 == 0, F.concat(s, F.lit("?"))).otherwise(F.concat(F.lit("A: "), s)).alias("text")),
    )
    return table(spark, d, "documents").select("doc_id", F.explode(X.block_pairs(blocks)).alias("p")).select("doc_id", "p.*")


@query(
    "recover_qa_json",
    f"""WITH {DOC_QA_CTE} SELECT pos AS id, 0 AS pos, question, answer FROM qa WHERE pos % 4 <> 3
    UNION ALL SELECT pos AS id, 1 AS pos, answer AS question, question AS answer FROM qa WHERE pos % 4 IN (0, 2)""".replace("0 AS pos", "CAST(0 AS BIGINT) AS pos").replace("1 AS pos", "CAST(1 AS BIGINT) AS pos"),
)
def recover_qa_json(spark, d):
    one = F.to_json(F.struct(F.col("question").alias("Q"), F.col("answer").alias("A")))
    two = F.to_json(F.struct(F.col("answer").alias("Q"), F.col("question").alias("A")))
    form = F.col("id") % 4
    raw = (
        F.when(form == 0, F.concat(one, F.lit("\n\n"), two))
        .when(form == 1, F.concat(one, F.lit('\nsome prose\n{"Q": "no answer"}')))
        .when(form == 2, F.concat(F.lit("[\n"), one, F.lit(",\n"), two, F.lit("\n]")))
        .otherwise("no pairs here")
    )
    return X.recover_qa_json(doc_qa(spark, d).withColumnRenamed("pos", "id").select("id", raw.alias("raw")))


# ---------------------------------------------------------------- composed

_MIXED = "<dl><dt>{q}?</dt><dd>{a}</dd></dl><h3>{q}?</h3><p>{a}</p><table><tr><td>{q}?</td><td>{a}</td></tr></table><p>Q: {q}</p><p>A: {a}</p>"


# What each rule finds in such a page: three of them need an answer, the lettered paragraphs and the section under the heading do not.
_UNION = f"""{DOC_QA_CTE}, t AS (SELECT pos AS page_id, {clean_sql("(question || '?')")} AS asked, {clean_sql("question")} AS q, {clean_sql("answer")} AS a, {clean_sql("(answer || ' Q: ' || question || ' A: ' || answer)")} AS section FROM qa),
    u AS (SELECT page_id, rule, rule_ord, place, asked AS question, a AS answer FROM t, (VALUES ('definition_list', 2, 5), ('heading_next', 3, 7), ('table_rows', 6, 10)) r(rule, rule_ord, place) WHERE a <> ''
      UNION ALL SELECT page_id, 'block_sequence', 7, 13, q, a FROM t UNION ALL SELECT page_id, 'heading_section', 8, 7, asked, section FROM t)"""


@query("extract_qa", f"WITH {_UNION} SELECT page_id, rule, rule_ord, place AS pos, question, answer FROM u")
def extract_qa(spark, d):
    return X.extract_qa(D.page_dom(_written(spark, d, _MIXED))).select("page_id", "rule", "rule_ord", "pos", "question", "answer")


@query("extract_qa_first_hit", f"WITH {_UNION} SELECT page_id, rule, question, answer FROM u QUALIFY rule_ord = min(rule_ord) OVER (PARTITION BY page_id)")
def extract_qa_first_hit(spark, d):
    """Where a document has no more than one line, the first rules give nothing and a later one answers."""
    return X.extract_qa(D.page_dom(_written(spark, d, _MIXED)), mode="first_hit").select("page_id", "rule", "question", "answer")


@query("site_corpus")
def site_corpus_query(spark, d):
    return site_corpus(_written(spark, d, _MIXED)).select("page_id", "url", "rule", "question", "answer", "context")


@query("site_corpus_pages")
def site_corpus_pages(spark, d):
    """The stored pages with the rules that their markup can meet."""
    dom = D.drop_noise(D.page_dom(table(spark, d, "pages")))
    rule = X.heading_section(levels=["h1"], predicate="any", stop_tags=X.HEADINGS, take_tags=None)
    pairs = X.qa_rule(dom, rule, "heading_section").withColumn("rule_ord", F.lit(0))
    return clean_pairs(pairs, order=("page_id", "pos")).select("page_id", "question", "answer")


@query(
    "grouped_by_url",
    f"""WITH {LINKS_CTE}, g AS (SELECT src AS url, string_agg(href || '>' || pos, ' ' ORDER BY pos, href) AS faqs FROM links GROUP BY ALL) SELECT url, faqs FROM g""",
)
def grouped_by_url_query(spark, d):
    links = _links(spark, d).select(F.col("src").alias("url"), "pos", F.col("href").alias("question"), F.col("pos").cast("string").alias("answer"))
    out = grouped_by_url(links)
    return out.withColumn("faqs", F.array_join(F.transform("faqs", lambda f: F.concat(f["Q"], F.lit(">"), f["A"])), " "))
