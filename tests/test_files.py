"""Sitemap files and grouped lines of any size."""

import gzip
import json

from pyspark.sql import functions as F

from qaforge.sources import readers as R
from qaforge.sources import writers as W

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'


def test_sitemap_files(spark, tmp_path):
    many = "".join(f"<url>\n <loc>http://a.example/{i}?x=1&amp;y={i}</loc>\n</url>" for i in range(50_000))
    index = "".join(f"<sitemap><loc>http://a.example/map{i}.xml</loc></sitemap>\n" for i in range(3))
    texts = {
        "large.xml": f"<urlset {NS}>{many}</urlset>", "index.xml": f'<?xml version="1.0"?><sitemapindex {NS}>{index}</sitemapindex>',
        "image.xml": f"<urlset {NS}><url><loc> http://b.example/ </loc><image:image><image:loc>http://b.example/x.png</image:loc></image:image></url><url><loc></loc></url><url><lastmod>1</lastmod></url></urlset>",
        "broken.xml": "<urlset><url><loc>http://c.example/1</loc></url><url><LOC>http://c.example/2&x</LOC></url></urlset>",
        "nothing.xml": "no xml at all", "empty.xml": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "packed.xml.gz").write_bytes(gzip.compress(texts["index.xml"].encode()))
    (tmp_path / "hidden.xml").write_bytes(gzip.compress(texts["image.xml"].encode()))
    rows = R.read_sitemap_files(spark, str(tmp_path)).withColumn("sitemap", F.element_at(F.split("sitemap", "/"), -1)).collect()
    found = {}
    for r in rows:
        found.setdefault((r.sitemap, r.kind), {})[r.pos] = r.loc
    maps = {i: f"http://a.example/map{i}.xml" for i in range(3)}
    assert found.pop(("large.xml", "url")) == {i: f"http://a.example/{i}?x=1&y={i}" for i in range(50_000)}
    assert found == {
        ("index.xml", "sitemap"): maps, ("packed.xml.gz", "sitemap"): maps, ("image.xml", "url"): {0: "http://b.example/"},
        ("broken.xml", "url"): {0: "http://c.example/1", 1: "http://c.example/2&x"}, ("hidden.xml", "url"): {0: "http://b.example/"},
    }


def test_grouped_lines(spark, tmp_path):
    rows = [("u1", 2, "b \"q\"\nx", "é"), ("u1", 1, "a", None), ("u2", 1, "c", "d"), (None, 5, "e", "f"), ("u1", 2, "a2", "z")]
    rows += [("hot", i, f"q{i}", "a" * 50) for i in range(30_000)]
    df = spark.createDataFrame(rows, "url string, pos int, question string, answer string").repartition(6)
    W.write_grouped_by_url(df, f"{tmp_path}/out")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split("\n") if x.strip()]
    got = {x.get("url"): x["faqs"] for x in lines}
    assert len(lines) == 4 and got["hot"] == [{"Q": f"q{i}", "A": "a" * 50} for i in range(30_000)]
    assert got["u1"] == [{"Q": "a"}, {"Q": "a2", "A": "z"}, {"Q": 'b "q"\nx', "A": "é"}] and got["u2"] == [{"Q": "c", "A": "d"}] and got[None] == [{"Q": "e", "A": "f"}]
    back = spark.read.schema("url string, faqs array<struct<Q string, A string>>").json(f"{tmp_path}/out")
    assert back.count() == 4 and back.select(F.sum(F.size("faqs"))).first()[0] == len(rows)
    W.write_grouped_by_url(df.limit(0), f"{tmp_path}/none")
    assert spark.read.text(f"{tmp_path}/none").count() == 0
