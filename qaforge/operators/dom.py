"""Pages as element tables.

One page stays one row: its elements and its text runs are two arrays. A rule over a page is then an expression over
its own row, so no rule shuffles, and the parse runs once however many rules follow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions.common import let, texts
from qaforge.rules import lexicons as R

# Elements that never have content.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements whose text is not page text.
_SILENT = {"script", "style", "template"}

_NODE = pa.struct(
    [
        ("id", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("sib", pa.int32()),
        ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("t0", pa.int32()), ("t1", pa.int32()),
        ("raw", pa.string()),
    ]
)
_PIECE = pa.struct([("node", pa.int32()), ("text", pa.string())])
_NODES, _PIECES = pa.list_(_NODE), pa.list_(_PIECE)
NODES_DDL = (
    "array<struct<id:int,end:int,parent:int,depth:int,sib:int,tag:string,attrs:map<string,string>,t0:int,t1:int,"
    "raw:string>>"
)
PIECES_DDL = "array<struct<node:int,text:string>>"


class _Flat(HTMLParser):
    """Document order list of elements, each with the span of text runs under it.

    No end tags are implied: void elements close at once, an end tag closes up to its nearest open element, and one
    without an open element is ignored.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.pieces: list[dict] = []
        self.open: list[dict] = []
        self.children: dict[int, int] = {}
        self.counts: Counter = Counter()  # open elements by tag
        self.buffer: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text:
            return
        owner = self.open[-1] if self.open else None
        if owner and owner["tag"] in _SILENT:
            owner["raw"] = (owner["raw"] or "") + text
        else:
            self.pieces.append({"node": owner["id"] if owner else -1, "text": text})

    def _close(self, node: dict) -> None:
        node["end"] = len(self.nodes) - 1
        node["t1"] = len(self.pieces)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        parent = self.open[-1] if self.open else None
        pid = parent["id"] if parent else -1
        sib = self.children.get(pid, 0)
        self.children[pid] = sib + 1
        i = len(self.nodes)
        node = {
            "id": i, "end": i, "parent": pid, "depth": len(self.open), "sib": sib, "tag": tag,
            "attrs": list({k: v or "" for k, v in attrs}.items()), "t0": len(self.pieces), "t1": len(self.pieces),
            "raw": None,
        }
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.counts[tag]:
            while True:
                node = self.open.pop()
                self.counts[node["tag"]] -= 1
                self._close(node)
                if node["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> tuple[list[dict], list[dict]]:
        self.close()
        self._flush()
        while self.open:
            self._close(self.open.pop())
        return self.nodes, self.pieces


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        # A few pages at a time, so that a batch of large pages is never held as Python objects all at once.
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            nodes, pieces = [], []
            for html in part.column(at).to_pylist():
                parser = _Flat()
                parser.feed(html or "")
                n, p = parser.finish()
                nodes.append(n)
                pieces.append(p)
            names = [f for f in part.schema.names if f != "html"]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in names] + [pa.array(nodes, _NODES), pa.array(pieces, _PIECES)],
                names=names + ["nodes", "pieces"],
            )


def page_dom(pages: DataFrame) -> DataFrame:
    """Every column but `html`, plus the arrays `nodes` and `pieces`, one row per page."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    source = pages.select(*[f.name for f in kept], "html")
    return source.mapInArrow(_parse, f"{ddl}, nodes {NODES_DDL}, pieces {PIECES_DDL}")


def node_text(node: Column, pieces: Column | str = "pieces") -> Column:
    """Text under an element: its runs joined by single spaces."""
    p = F.col(pieces) if isinstance(pieces, str) else pieces
    return F.array_join(F.slice(p, node["t0"] + 1, node["t1"] - node["t0"])["text"], " ")


def dom_nodes(pages: DataFrame) -> DataFrame:
    """One row per element: (page_id, url, node_id, end_id, parent_id, depth, sib_idx, tag, attrs, text)."""
    dom = pages if "nodes" in pages.columns else page_dom(pages)
    kept = [c for c in dom.columns if c not in ("nodes", "pieces")]
    n = F.col("n")
    return dom.select(*kept, "pieces", F.explode(F.filter("nodes", lambda e: e["tag"] != "")).alias("n")).select(
        *kept,
        n["id"].alias("node_id"), n["end"].alias("end_id"), n["parent"].alias("parent_id"),
        n["depth"].alias("depth"), n["sib"].alias("sib_idx"), n["tag"].alias("tag"), n["attrs"].alias("attrs"),
        node_text(n).alias("text"),
    )


def attr(node: Column, name: str) -> Column:
    return F.coalesce(node["attrs"][name], F.lit(""))


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def below(outer: Column) -> Column:
    """The elements under an element, which follow it in page order."""
    return F.slice("nodes", outer["id"] + 2, outer["end"] - outer["id"])


def drop_noise(
    dom: DataFrame, tags: Sequence[str] = tuple(R.NOISE_TAGS), ids: Sequence[str] = (), classes: Sequence[str] = (),
    roles: Sequence[str] = (), exact_ids: Sequence[str] = (),
) -> DataFrame:
    """Remove the subtrees of noisy elements: by tag, by part of id or class, by whole id, by role.

    Removed elements keep their place without tag and attributes, so an element's id stays its index.
    """

    def noisy(n: Column) -> Column:
        test = n["tag"].isin(list(tags)) if tags else F.lit(False)
        for part in ids:
            test = test | F.contains(F.lower(attr(n, "id")), F.lit(part))
        for part in classes:
            test = test | F.contains(F.lower(attr(n, "class")), F.lit(part))
        if exact_ids:
            test = test | attr(n, "id").isin(list(exact_ids))
        if roles:
            test = test | attr(n, "role").isin(list(roles))
        return test

    # Outermost noisy elements only: each later one inside an earlier one adds nothing.
    spans = F.aggregate(
        F.filter("nodes", noisy),
        F.array().cast("array<struct<id:int,end:int>>"),
        lambda acc, n: F.when(
            (F.size(acc) > 0) & (n["id"] <= F.element_at(acc, -1)["end"]), acc
        ).otherwise(F.array_append(acc, F.struct(n["id"].alias("id"), n["end"].alias("end")))),
    )

    def flags(cut: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            before = F.coalesce(F.get(cut, k - 1)["end"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(False), s["id"] - before - 1), F.array_repeat(F.lit(True), s["end"] - s["id"] + 1))

        return F.flatten(F.transform(cut, part))

    marked = dom.withColumn("_cut", let(spans, flags))

    def inside(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_cut"), i), F.lit(False))

    def blank(n: Column) -> Column:
        kept = [n[c].alias(c) for c in ("id", "end", "parent", "depth", "sib")]
        none = F.create_map().cast("map<string,string>")
        return F.struct(*kept, F.lit("").alias("tag"), none.alias("attrs"), n["t0"].alias("t0"), n["t1"].alias("t1"), F.lit(None).cast("string").alias("raw"))

    return marked.withColumns(
        {
            "nodes": F.transform("nodes", lambda n: F.when(inside(n["id"]), blank(n)).otherwise(n)),
            # Blanked and not removed, so that the text spans of the elements stay valid.
            "pieces": F.transform(
                "pieces",
                lambda p: F.struct(p["node"].alias("node"), F.when(~inside(p["node"]), p["text"]).alias("text")),
            ),
        }
    ).drop("_cut")


def page_text(dom: DataFrame) -> DataFrame:
    """(…, text): visible text of a page, then each preformatted block after a blank line, taken before the cut."""
    kept = [c for c in dom.columns if c not in ("nodes", "pieces")]
    pre = F.transform(
        F.filter("nodes", lambda n: n["tag"] == "pre"),
        lambda n: F.array_join(F.slice("pieces", n["t0"] + 1, n["t1"] - n["t0"])["text"], "\n"),
    )
    marked = dom.withColumn("_pre", F.array_join(pre, "\n\n"))
    clean = drop_noise(marked, tags=R.NOISE_TAGS_TEXT, roles=["navigation"], exact_ids=R.NOISE_IDS_TEXT)
    body = F.array_join(F.col("pieces")["text"], " ")
    return clean.select(*kept, F.trim(F.concat(body, F.lit("\n\n"), F.col("_pre"))).alias("text")).withColumn(
        "text", F.regexp_replace("text", r"^\s+|\s+$", "")
    )


def raw_text(dom: DataFrame) -> DataFrame:
    """(…, text): every text run on its own line, for rules that read the page as lines."""
    kept = [c for c in dom.columns if c not in ("nodes", "pieces")]
    return dom.select(*kept, F.array_join(F.col("pieces")["text"], "\n").alias("text"))


__all__ = [
    "attr", "below", "dom_nodes", "drop_noise", "has_attr", "node_text", "page_dom", "page_text", "raw_text", "texts",
]
