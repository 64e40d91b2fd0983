"""Hand-written pages, sitemaps and link graphs."""


from qaforge.operators import dom as D
from qaforge.operators import extract as X
from qaforge.operators import links as K
from qaforge.sources.readers import read_sitemaps

PAGE = """<html><head><title>t</title>
<script type="application/ld+json">{"@type":["FAQPage","X"],"mainEntity":[
 {"@type":"Question","name":"LD q?","acceptedAnswer":{"@type":"Answer","text":"LD a"}},{"name":"Str q?","answer":"plain"}]}</script>
<script type="application/ld+json">{"@graph":[{"@type":"FAQPage","mainEntity":[{"name":"G q?","acceptedAnswer":{"text":"G a"}}]}]}</script>
<script type="application/ld+json">{bad</script></head><body>
<nav><h3>Nav?</h3><p>no</p></nav>
<details><summary>D q</summary><p>one</p><p>two</p></details>
<dl><dt>T1</dt><dd>D1</dd><dt>T2</dt><dt>T3</dt><dd>D3</dd></dl>
<h3>How do I x?</h3><p>para</p><ul><li>a</li></ul><h3>Next?</h3><p>Q: block one</p><p>A: ans one</p><p>more</p>
<div class="accordion-item"><h4>Acc q</h4><div class="accordion-item"><button>Inner q</button><p>Inner a</p></div></div>
<table><tr><td>Cell q?</td><td>Cell a</td></tr><tr><td>x</td></tr></table>
<p>Unclosed <b>bold<p>Last question?</p><p>Last answer</p></body></html>"""


def rule(spark, expr, html=PAGE, noise=False):
    dom = D.page_dom(spark.createDataFrame([(1, "http://a.b/c", html)], "page_id long, url string, html string"))
    dom = D.drop_noise(dom) if noise else dom
    return [(r.question, r.answer) for r in X.qa_rule(dom, expr).orderBy("pos").collect()]


def test_structured_data(spark):
    assert rule(spark, "jsonld") == [("LD q?", "LD a"), ("Str q?", "plain"), ("G q?", "G a")]
    assert rule(spark, "jsonld", noise=True) == []


def test_element_rules(spark):
    assert rule(spark, "details") == [("D q", "one two")]
    assert rule(spark, X.details(content="first")) == [("D q", "one")]
    assert rule(spark, X.details(content="rest")) == [("D q", "one two")]
    assert rule(spark, "definition_list") == [("T1", "D1"), ("T2", "D3"), ("T3", "D3")]
    assert rule(spark, "heading_next", noise=True) == [("How do I x?", "para"), ("Next?", "Q: block one")]
    assert rule(spark, "heading_next")[0] == ("Nav?", "no")
    assert rule(spark, "table_rows") == [("Cell q?", "Cell a")]
    assert rule(spark, "accordion_item") == [("Acc q", "Inner q Inner a"), ("Inner q", "Inner a")]


def test_block_walk_flush(spark):
    kept, cut = rule(spark, X.block_sequence(), noise=True), rule(spark, X.block_sequence(flush_last=False), noise=True)
    assert kept[-1] == ("Last question?", "Last answer")
    assert cut == kept[:-1]


def test_first_hit_and_compat(spark):
    dom = D.page_dom(spark.createDataFrame([(1, "u", PAGE), (2, "v", None)], "page_id long, url string, html string"))
    assert {r.rule for r in X.extract_qa(dom, mode="first_hit").collect()} == {"jsonld"}
    assert "jsonld" not in {r.rule for r in X.extract_qa(dom, compat=True).collect()}


def test_nodes_cover_subtrees(spark):
    nodes = D.dom_nodes(spark.createDataFrame([(1, "u", "<div><p>a<b>c</b></p> d</div></i>")], "page_id long, url string, html string"))
    got = [(r.node_id, r.end_id, r.parent_id, r.tag, r.text) for r in nodes.orderBy("node_id").collect()]
    assert got == [(0, 2, -1, "div", "a c d"), (1, 2, 0, "p", "a c"), (2, 2, 1, "b", "c")]


def test_sitemaps(spark):
    rows = [
        ("i", '<sitemapindex xmlns="x"><sitemap><loc>s</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>'),
        ("s", "<urlset><url><loc> http://a/1?x&amp;y </loc></url></urlset>"),
        ("broken", "<urlset><url><loc>http://b/1</loc></url><url><loc>http://a/1?x&y</loc>"),
    ]
    entries = read_sitemaps(spark.createDataFrame(rows, "sitemap string, body string"))
    assert {(r.sitemap, r.kind, r.loc) for r in entries.collect()} >= {("i", "sitemap", "s"), ("s", "url", "http://a/1?x&y"), ("broken", "url", "http://b/1")}
    roots = spark.createDataFrame([("i", 0), ("broken", 1)], "sitemap string, pos int")
    out = [r["loc"] for r in K.expand_sitemap_index(entries, roots).orderBy("path").collect()]
    assert out == ["http://a/1?x&y", "http://b/1"]


def test_bfs_first_depth_and_domain(spark):
    e = [("http://a/0", "http://a/1"), ("http://a/1", "http://a/2"), ("http://a/0", "http://a/2"), ("http://a/2", "http://a/0"),
         ("http://a/2", "http://a/3"), ("http://a/3", "http://a/4"), ("http://a/0", "http://a:81/x"), ("http://a/4", "http://a/5")]
    edges, roots = spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([("http://a/0",)], "url string")
    want = {"http://a/0": 0, "http://a/1": 1, "http://a/2": 1, "http://a/3": 2, "http://a/4": 3}
    assert {r["url"]: r["depth"] for r in K.bfs(edges, roots, 3).collect()} == want
    limit, K.BROADCAST_ROWS = K.BROADCAST_ROWS, 0
    try:
        assert {r["url"]: r["depth"] for r in K.bfs(edges, roots, 3).collect()} == want
    finally:
        K.BROADCAST_ROWS = limit


def test_links_match_parsed_page(spark):
    html = '<a class="x" href="/a?x=1&amp;y=2">1</a><A HREF=\'b\'>2</A><a name="n">3</a><a href=c>4</a>'
    pages = spark.createDataFrame([("http://h/p/", html)], "url string, html string")
    assert [r.href for r in K.extract_links(pages).orderBy("pos").collect()] == ["/a?x=1&y=2", "b", "c"]
    assert [r.dst for r in K.resolve_links(K.extract_links(pages)).orderBy("pos").collect()] == ["http://h/a?x=1&y=2", "http://h/p/b", "http://h/p/c"]


def test_next_beside_skips_other_parents_and_noise(spark):
    html = """<div><h3>One?</h3><nav><p>no</p></nav><section><p>deep</p></section><p>yes</p></div><p>outside</p>
    <div><h3>Two?</h3></div><p>after</p><h3>Three?</h3><nav>x</nav><p>last</p>"""
    assert rule(spark, X.heading_next(blocks=("p",)), html, noise=True) == [("One?", "yes"), ("Three?", "last")]
    assert rule(spark, X.heading_next(blocks=("p",), adjacent=True), html, noise=True) == [("Three?", "last")]
    assert rule(spark, X.heading_section(take_tags=None), html, noise=True) == [("One?", "deep yes"), ("Three?", "last")]


def test_rules_stay_linear_in_page_size(spark):
    import time

    block = "<div class='accordion-item'><h3>How is it?</h3><p>It is.</p></div><h3>Q?</h3><p>para</p><nav>x</nav><dl><dt>t</dt><dd>d</dd></dl>"

    def seconds(n):
        dom = D.page_dom(spark.createDataFrame([(1, "u", block * n)], "page_id long, url string, html string"))
        start = time.perf_counter()
        assert X.extract_qa(dom).count() == 8 * n
        return time.perf_counter() - start

    seconds(2)  # planning and workers
    assert seconds(2400) < 3 * seconds(1200) + 5


def test_jsonld_of_every_shape(spark):
    import json

    from qaforge.operators.dom import page_dom

    def item(n, answer=None, **more):
        return {"@type": "Question", "name": f"q{n}?", "acceptedAnswer": answer if answer is not None else {"@type": "Answer", "text": f"a{n}"}, **more}

    faq = {"@type": "FAQPage"}
    shapes = [
        ({**faq, "mainEntity": [item(1), item(2)]}, [1, 2]),
        ({**faq, "mainEntity": item(1)}, [1]),
        ([{**faq, "mainEntity": item(1)}, {"@type": "Thing", "mainEntity": item(9)}, [{**faq, "mainEntity": item(2)}]], [1, 2]),
        ({"@type": ["WebPage", "FAQPage"], "mainEntity": item(1)}, [1]),
        ({"type": "faqpage", "mainEntity": [item(1)]}, [1]),
        ({"@graph": [{"@graph": [{"@graph": {**faq, "mainEntity": [item(3)]}}, {**faq, "mainEntity": item(2)}]}, {**faq, "mainEntity": item(1)}]}, [1, 2, 3]),
        ({**faq, "mainEntity": [item(1, "a1"), item(2, [{"text": "a2"}, {"text": "other"}]), item(3, ["a3"]), None, item(4, {"text": None}), {"name": 5, "acceptedAnswer": {"text": 6}}]}, [1, 2, 3, "5:6"]),
        ({**faq, "mainEntity": [{"headline": "q1?", "answer": "a1"}, {"question": "q2?", "answer": {"text": "a2"}}, {"text": "q3?", "acceptedAnswer": {"text": "a3"}}]}, [1, 2, 3]),
        ({**faq, "mainEntity": None, "@graph": None}, []), ("text", []), (7, []), (None, []), ({"@type": {"x": 1}, "mainEntity": item(1)}, []), ({**faq, "@graph": [{**faq, "mainEntity": item(2)}], "mainEntity": item(1)}, [1, 2]),
    ]
    pages = [(i, f'<script type="application/ld+json">{json.dumps(x)}</script>') for i, (x, _) in enumerate(shapes)] + [(len(shapes), '<script type="application/ld+json">{"@type": "FAQPage", </script>')]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages], "page_id int, url string, html string")
    got = {}
    for r in X.qa_rule(page_dom(df), "jsonld").collect():
        got.setdefault(r.page_id, []).append((r.question, r.answer))
    for i, (_, want) in enumerate(shapes):
        pairs = [tuple(w.split(":")) if isinstance(w, str) else (f"q{w}?", f"a{w}") for w in want]
        assert got.get(i, []) == pairs, shapes[i]
    assert len(shapes) not in got
