"""Question and answer pairs from pages.

Each rule is an expression over one page's arrays (see dom.py) that yields an array of (pos, question, answer).
`extract_qa` evaluates the chosen rules side by side on the same parsed page, with no shuffle between them.

An element's id is its index, so what lies under it is a slice, and the next element of a kind is found by counting: no rule scans the page
once per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions import text as T
from qaforge.functions.common import WS, let, lines, strip, words
from qaforge.operators.dom import attr, below, drop_noise, has_attr, node_text
from qaforge.rules import lexicons as R

PAIRS = "array<struct<pos:int,question:string,answer:string>>"
BLOCK_TAGS = ["p", "div", "section", "article", "ul", "ol"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
SEQUENCE_TAGS = ["p", "div", "li", "span", "strong", "b"]
PREFIX_TAGS = ["p", "div", "li", "span", "h2", "h3", "h4", "strong", "b"]

Clean = Callable[[Column], Column]


def _nodes(test: Callable[[Column], Column]) -> Column:
    return F.filter("nodes", test)


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _tag(*names: str) -> Callable[[Column], Column]:
    return lambda n: n["tag"].isin(list(names))


def _at(i: Column) -> Column:
    return F.get(F.col("nodes"), i)


def _inside(outer: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(below(outer), test)


def _next_ids(test: Callable[[Column], Column]) -> Column:
    """By element id, the id of the next element of the page that passes; ends where no more do."""

    def fill(ids: Column) -> Column:
        return F.flatten(F.transform(ids, lambda i, k: F.array_repeat(i, i - F.coalesce(F.get(ids, k - 1), F.lit(0)))))

    return let(F.transform(_nodes(test), lambda n: n["id"]), fill)


def _with_next(marks: Column, test: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """`build(mark, next)` for each mark in page order; next is the first later sibling that passes, or null.

    Marks and siblings are sorted together by parent; what stands before a mark and is no mark tells the place of its next one.
    """

    def keyed(nodes: Column, kind: int) -> Column:
        return F.transform(nodes, lambda n: F.struct(n["parent"].alias("parent"), n["id"].alias("id"), F.lit(kind).alias("kind")))

    def found(entries: Column) -> Column:
        asks = F.transform(entries, lambda m, k: F.when(m["kind"] == 1, F.struct(m["parent"].alias("parent"), m["id"].alias("id"), k.alias("k"))))

        def pairs(blocks: Column) -> Column:
            def one(ask: Column, j: Column) -> Column:
                block = F.get(blocks, ask["k"] - j)
                return F.struct(ask["id"].alias("id"), F.when(block["parent"] == ask["parent"], block["id"]).alias("next"))

            return F.sort_array(F.transform(F.filter(asks, lambda x: x.isNotNull()), one))

        return let(F.filter(entries, lambda m: m["kind"] == 0), pairs)

    entries = F.sort_array(F.concat(keyed(_nodes(test), 0), keyed(marks, 1)))
    return F.transform(let(entries, found), lambda m: build(_at(m["id"]), _at(m["next"])))


def _text(node: Column) -> Column:
    return F.when(node.isNotNull(), node_text(node))


def _pair(pos: Column, q: Column, a: Column) -> Column:
    return F.struct(pos.alias("pos"), q.alias("question"), F.coalesce(a, F.lit("")).alias("answer"))


def _both(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def _class_has(n: Column, part: str, any_case: bool = True) -> Column:
    cls = attr(n, "class")
    return F.contains(F.lower(cls) if any_case else cls, F.lit(part))


# ---------------------------------------------------------------- structured data

# Levels of `@graph` inside one another that are looked into.
GRAPH_DEPTH = 5


def _list(value: Column, path: str) -> Column:
    """What a variant holds at the path as a list: the members of a list, a single value by itself, nothing for null or a missing one."""
    one = F.try_variant_get(value, path, "variant")
    many = F.try_variant_get(value, path, "array<variant>")
    return F.when(one.isNull() | F.is_variant_null(one), F.array().cast("array<variant>")).otherwise(F.coalesce(many, F.array(one)))


def _each(values: Column, path: str) -> Column:
    return F.flatten(F.transform(values, lambda v: _list(v, path)))


def _said(value: Column, *names: str) -> Column:
    """The first of the named members that is there, as text."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", "string") for n in names], F.lit(""))


def jsonld(clean: Clean = strip, types: Sequence[str] = ("FAQPage", "QAPage"), depth: int = GRAPH_DEPTH) -> Column:
    """Pairs of FAQ structured data of any shape: a page object, lists of them, `@graph` in `@graph` down to `depth`.

    Types, main entities and answers may be single values or lists; of several answers the first counts. The JSON is read without a schema.
    """

    def wanted(doc: Column) -> Column:
        kinds = F.transform(F.concat(_list(doc, '$["@type"]'), _list(doc, "$.type")), lambda k: F.coalesce(F.try_variant_get(k, "$", "string"), F.lit("")))
        # Any type with FAQ in its name, and any that begins with it in either case.
        return F.exists(kinds, lambda k: k.isin(list(types)) | F.contains(k, F.lit("FAQ")) | F.startswith(F.lower(k), F.lit("faq")))

    def answer(item: Column) -> Column:
        first = F.get(F.concat(_list(item, "$.acceptedAnswer"), _list(item, "$.answer")), F.lit(0))
        text = F.try_variant_get(first, "$.text", "string")
        return F.coalesce(text, F.when(~F.schema_of_variant(first).startswith("OBJECT"), F.try_variant_get(first, "$", "string")), F.lit(""))

    def docs(script: Column) -> Column:
        # A list may hold lists.
        level = _each(_each(F.array(F.try_parse_json(script["raw"])), "$"), "$")
        found = [level]
        for _ in range(depth):
            level = _each(level, '$["@graph"]')
            found.append(level)
        return F.filter(F.concat(*found), wanted)

    def pairs(script: Column) -> Column:
        items = _each(docs(script), "$.mainEntity")
        return F.transform(items, lambda i: _pair(script["id"], clean(_said(i, "name", "headline", "question", "text")), clean(answer(i))))

    scripts = _nodes(lambda n: (n["tag"] == "script") & F.contains(attr(n, "type"), F.lit("ld+json")) & n["raw"].isNotNull())
    return _both(F.flatten(F.transform(scripts, pairs)))


def microdata(clean: Clean = strip) -> Column:
    """Pairs marked with item properties inside an FAQ item scope."""

    def prop(name: str) -> Callable[[Column], Column]:
        return lambda n: attr(n, "itemprop") == name

    def item(i: Column) -> Column:
        q, a = _first(_inside(i, prop("name"))), _first(_inside(i, prop("acceptedAnswer")))
        return F.when(q.isNotNull() & a.isNotNull(), _pair(i["id"], clean(_text(q)), clean(_text(a))))

    scopes = _nodes(lambda n: has_attr(n, "itemscope") & F.contains(attr(n, "itemtype"), F.lit("FAQPage")))
    found = F.flatten(F.transform(scopes, lambda s: F.transform(_inside(s, prop("mainEntity")), item)))
    return F.filter(found, lambda p: p.isNotNull())


# ---------------------------------------------------------------- element rules


def details(clean: Clean = T.clean_text, content: str = "all") -> Column:
    """Disclosure elements: summary as question; all content blocks, the first one, or the rest of the text."""

    def one(d: Column) -> Column:
        summary = _first(_inside(d, _tag("summary")))
        if content == "all":
            blocks = _inside(d, _tag(*BLOCK_TAGS))
            answer = F.array_join(F.transform(blocks, lambda b: clean(node_text(b))), " ")
        elif content == "first":
            answer = clean(F.coalesce(_text(_first(_inside(d, _tag(*BLOCK_TAGS)))), F.lit("")))
        elif content == "rest":
            whole, q = node_text(d), _text(summary)
            at = F.instr(whole, q)
            answer = strip(F.concat(F.substr(whole, F.lit(1), at - 1), F.substr(whole, at + F.length(q))))
        else:
            raise ValueError(f"unknown content: {content}")
        return F.when(summary.isNotNull(), _pair(d["id"], clean(_text(summary)), answer))

    def ok(p: Column) -> Column:
        answered = p["answer"] != ""
        if content != "rest":
            answered = answered | p["question"].endswith("?")
        return p.isNotNull() & (p["question"] != "") & answered

    return F.filter(F.transform(_nodes(_tag("details")), one), ok)


def definition_list(clean: Clean = T.clean_text) -> Column:
    """Each term with the next definition beside it."""

    def one(dt: Column, dd: Column) -> Column:
        return _pair(dt["id"], clean(node_text(dt)), clean(F.coalesce(_text(dd), F.lit(""))))

    return _both(_with_next(_nodes(_tag("dt")), _tag("dd"), one))


def _predicate(name: str) -> Clean:
    tests: dict[str, Clean] = {
        "question": T.looks_like_question,
        "mark": lambda t: F.contains(t, F.lit("?")),
        "ends": lambda t: t.endswith("?"),
        "keyword": lambda t: t.endswith("?") | t.rlike(r"(?i)\b(faq|question|help|how to|troubleshoot)\b"),
        "mark_or_keyword": lambda t: F.contains(t, F.lit("?")) | t.rlike(r"(?i)question|faq|help"),
        "ends_or_word": lambda t: t.endswith("?") | t.rlike(r"(?i)\b(what|why|how|when|where|who)\b"),
        "any": lambda t: t != "",
    }
    return tests[name]


def heading_next(
    clean: Clean = T.clean_text, levels: Sequence[str] = ("h2", "h3", "h4"), predicate: str = "question",
    blocks: Sequence[str] = tuple(BLOCK_TAGS), adjacent: bool = False,
) -> Column:
    """Question-like heading with the first block beside it; `adjacent` wants the very next element to be it."""
    test = _predicate(predicate)

    def one(h: Column, nxt: Column) -> Column:
        if adjacent:
            nxt = F.when(nxt["tag"].isin(list(blocks)), nxt)
        return _pair(h["id"], clean(node_text(h)), clean(F.coalesce(_text(nxt), F.lit(""))))

    beside = _with_next(_nodes(_tag(*levels)), (lambda n: n["tag"] != "") if adjacent else _tag(*blocks), one)
    return F.filter(_both(beside), lambda p: test(p["question"]))


def heading_section(
    clean: Clean = T.clean_text, levels: Sequence[str] = ("h3",), predicate: str = "ends",
    stop_tags: Sequence[str] = ("h3",), take_tags: Sequence[str] | None = ("p", "div", "ul", "ol"),
    max_steps: int | None = None,
) -> Column:
    """Heading with everything beside it up to the next heading."""
    test = _predicate(predicate)

    def entry(n: Column) -> Column:
        return F.struct(
            n["parent"].alias("parent"), n["id"].alias("id"), n["tag"].isin(list(stop_tags)).alias("stop"), n["tag"].isin(list(levels)).alias("head"),
        )

    def events(order: Column) -> Column:
        """Places of section ends (kind 0: a stop, or the first child of another parent) and of headings (kind 1), in order."""

        def at(m: Column, k: Column) -> Column:
            ends = m["stop"] | ~m["parent"].eqNullSafe(F.get(order, k - 1)["parent"])
            return F.filter(
                F.array(F.struct(F.lit(0).alias("kind"), k.alias("k"), ends.alias("ok")), F.struct(F.lit(1).alias("kind"), k.alias("k"), m["head"].alias("ok"))),
                lambda e: e["ok"],
            )

        return F.flatten(F.transform(order, at))

    def sections(order: Column) -> Column:
        def each(found: Column) -> Column:
            heads = F.filter(F.transform(found, lambda e, i: F.when(e["kind"] == 1, F.struct(e["k"].alias("k"), i.alias("i")))), lambda e: e.isNotNull())

            def built(ends: Column) -> Column:
                def one(e: Column, j: Column) -> Column:
                    end = F.coalesce(F.get(ends, e["i"] - j)["k"], F.size(order))
                    h = _at(F.get(order, e["k"])["id"])
                    section = F.slice(order, e["k"] + 2, end - e["k"] - 1)
                    section = F.transform(F.slice(section, 1, max_steps) if max_steps else section, lambda m: _at(m["id"]))
                    if take_tags:
                        section = F.filter(section, _tag(*take_tags))
                    answer = F.array_join(F.filter(F.transform(section, lambda n: node_text(n)), lambda t: t != ""), " ")
                    return _pair(h["id"], clean(node_text(h)), clean(answer))

                return F.transform(heads, one)

            return let(F.filter(found, lambda e: e["kind"] == 0), built)

        return let(events(order), each)

    order = F.sort_array(F.transform(_nodes(lambda n: n["tag"] != ""), entry))
    return F.filter(_both(let(order, sections)), lambda p: test(p["question"]))


def heading_find_next_p(clean: Clean = strip) -> Column:
    """Second or third level heading about questions with the next paragraph anywhere later; may be unanswered."""

    def answered(nxt: Column) -> Column:
        def one(h: Column) -> Column:
            p = _at(F.get(nxt, h["id"]))
            return _pair(h["id"], clean(node_text(h)), clean(F.coalesce(_text(p), F.lit(""))))

        return F.transform(heads, one)

    heads = F.filter(_nodes(_tag("h2", "h3")), lambda h: node_text(h).rlike(r"(?i)faq|question|q:|\?"))
    return let(_next_ids(_tag("p")), answered)


# Fixed values: (class part, any case, question tags, answer tags, class parts of question and answer).
ACCORDIONS = {
    "item": ("accordion-item", False, ["h2", "h3", "h4", "button"], BLOCK_TAGS, None, None),
    "any": ("accordion", True, ["h2", "h3", "h4", "button"], BLOCK_TAGS, None, None),
    "trigger": ("accordion", True, ["button", "h2", "h3", "h4"], BLOCK_TAGS, "trigger", None),
    "expandable": (
        "itemExpander_module_expandableSection", False, ["h2", "h3", "button"], ["div"], None,
        "itemExpander_module_expandableSectionContent",
    ),
}


def accordion(variant: str = "any", clean: Clean = T.clean_text) -> Column:
    """First question tag and first answer tag inside each accordion block."""
    part, any_case, q_tags, a_tags, q_class, a_class = ACCORDIONS[variant]

    def is_q(n: Column) -> Column:
        test = n["tag"].isin(q_tags)
        return test & ((attr(n, "class") == "") | _class_has(n, q_class)) if q_class else test

    def is_a(n: Column) -> Column:
        test = n["tag"].isin(a_tags)
        return test & _class_has(n, a_class, False) if a_class else test

    def one(b: Column) -> Column:
        q, a = _first(_inside(b, is_q)), _first(_inside(b, is_a))
        return _pair(b["id"], clean(F.coalesce(_text(q), F.lit(""))), clean(F.coalesce(_text(a), F.lit(""))))

    blocks = _nodes(lambda n: (n["tag"] == "div") & _class_has(n, part, any_case))
    return _both(F.transform(blocks, one))


def table_rows(clean: Clean = T.clean_text) -> Column:
    """Rows of exactly two cells whose first one asks."""

    def one(tr: Column) -> Column:
        def cells(td: Column) -> Column:
            return F.when(
                F.size(td) == 2,
                _pair(tr["id"], clean(node_text(F.element_at(td, 1))), clean(node_text(F.element_at(td, 2)))),
            )

        return let(_inside(tr, _tag("td")), cells)

    found = F.filter(F.transform(_nodes(_tag("tr")), one), lambda p: p.isNotNull())
    return F.filter(_both(found), lambda p: p["question"].endswith("?"))


def _cut_at(blocks: Column, opens: Callable[[Column], Column], build: Callable[[Column, Column], Column], flush: bool) -> Column:
    """Split an array before every opening entry and build one value per part; `flush` keeps the last part."""

    def parts(bs: Column) -> Column:
        starts = F.filter(F.transform(bs, lambda b, i: F.when(opens(b), i)), lambda i: i.isNotNull())

        def each(at: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                end = F.coalesce(F.try_element_at(at, k + 2), F.size(bs))
                rest = F.slice(bs, start + 2, end - start - 1)
                value = build(F.element_at(bs, start + 1), rest)
                return value if flush else F.when(k + 1 < F.size(at), value)

            return F.filter(F.transform(at, one), lambda v: v.isNotNull())

        return let(starts, each)

    return let(blocks, parts)


_Q_MARK = f"(?i)^{WS}*q[:\\-]{WS}*"
_A_MARK = f"(?i)^{WS}*a[:\\-]{WS}*"


def block_pairs(blocks: Column, flush_last: bool = True) -> Column:
    """Pairs from text blocks in order, array<struct<pos,text>>: a block that asks opens a pair, later ones answer."""

    def build(q: Column, rest: Column) -> Column:
        answer = F.array_join(F.transform(rest, lambda b: F.regexp_replace(b["text"], _A_MARK, "")), " ")
        return F.when(F.size(rest) > 0, _pair(q["pos"], F.regexp_replace(q["text"], _Q_MARK, ""), answer))

    filled = F.filter(blocks, lambda b: b["text"] != "")
    found = _cut_at(filled, lambda b: b["text"].endswith("?") | b["text"].rlike(_Q_MARK), build, flush_last)
    return F.filter(found, lambda p: p["question"] != "")


def prefix_pairs(blocks: Column) -> Column:
    """Older walk: a block that starts with q or asks opens; the next one answers, and later ones that start with a."""

    def build(q: Column, rest: Column) -> Column:
        more = F.filter(rest, lambda b, i: (i == 0) | F.lower(b["text"]).startswith("a"))
        question = strip(F.replace(T.clean_text(q["text"]), F.lit("Q:"), F.lit("")))
        answer = strip(F.replace(T.clean_text(F.array_join(more["text"], " ")), F.lit("A:"), F.lit("")))
        return F.when(F.size(rest) > 0, _pair(q["pos"], question, answer))

    filled = F.filter(blocks, lambda b: b["text"] != "")
    found = _cut_at(
        filled, lambda b: F.lower(b["text"]).startswith("q") | b["text"].endswith("?"), build, True
    )
    return F.filter(found, lambda p: (F.length(p["question"]) > 3) & (F.length(p["answer"]) > 3))


def _blocks(tags: Sequence[str], clean: Clean | None = None) -> Column:
    return F.transform(
        _nodes(_tag(*tags)),
        lambda n: F.struct(n["id"].alias("pos"), (clean(node_text(n)) if clean else node_text(n)).alias("text")),
    )


def block_sequence(clean: Clean = T.clean_text, flush_last: bool = True) -> Column:
    return block_pairs(_blocks(SEQUENCE_TAGS, clean), flush_last)


def prefix_sequence() -> Column:
    return prefix_pairs(_blocks(PREFIX_TAGS))


# Fixed pattern: a question line, an answer line, up to the next question line or the end.
_QA_LINES = r"(?si)Q[:\-]?\s*(.*?)\n\s*A[:\-]?\s*(.*?)(?=\nQ[:\-]|\z)"


def text_regex(text: Column, clean: Clean = T.clean_text) -> Column:
    """Pairs written as Q and A lines in raw text."""
    qs = F.regexp_extract_all(text, F.lit(_QA_LINES), F.lit(1))
    as_ = F.regexp_extract_all(text, F.lit(_QA_LINES), F.lit(2))
    # One short scan rules out most texts before the backtracking pattern runs.
    likely = text.rlike(r"(?i)q[\s\S]*\n\s*a")
    pairs = F.transform(F.arrays_zip(qs.alias("q"), as_.alias("a")), lambda z, i: _pair(i, clean(z["q"]), clean(z["a"])))
    return F.when(likely, _both(pairs)).otherwise(F.array().cast(PAIRS))


def topic_grid(clean: Clean = T.clean_text, css: str = "lb-grid") -> Column:
    """In each grid block: third-level heading or strong text, then the blocks up to the next one of these."""
    marks = ("h3", "strong")

    def built(stops: Column) -> Column:
        def one(q: Column) -> Column:
            stop = F.coalesce(F.get(stops, q["id"]), F.size("nodes"))
            blocks = F.filter(F.slice("nodes", q["id"] + 2, stop - q["id"] - 1), _tag("p", "div", "ul", "ol", "li"))
            answer = strip(F.array_join(F.transform(blocks, lambda n: clean(node_text(n))), " "))
            return _pair(q["id"], clean(node_text(q)), clean(answer))

        return F.flatten(F.transform(grids, lambda g: F.transform(_inside(g, _tag(*marks)), one)))

    grids = _nodes(lambda n: (n["tag"] == "div") & F.array_contains(words(attr(n, "class")), F.lit(css)))
    return _both(let(_next_ids(_tag(*marks)), built))


def container(
    clean: Clean = strip, pattern: str = r"(?i)faq|faqs|question|qa|qna|help|support", variant: str = "next",
) -> Column:
    """Inner headings and paragraphs of blocks whose class or id tells of questions, with the text that follows.

    `next` takes two words or more and the next text element anywhere; `sibling` three words and the next one beside.
    """
    if variant == "next":
        outer, inner, n_words = ["div", "section", "article"], ["h2", "h3", "h4", "dt", "p", "strong"], 2
    else:
        outer, inner, n_words, pattern = ["div", "section"], ["h2", "h3", "h4", "p", "span"], 3, "(?i)faq"

    def is_outer(n: Column) -> Column:
        label = F.concat_ws(" ", attr(n, "class"), attr(n, "id")) if variant == "next" else attr(n, "class")
        return n["tag"].isin(outer) & label.rlike(pattern)

    def built(nxt: Column) -> Column:
        def one(q: Column) -> Column:
            after = _at(F.get(nxt, q["id"]))
            return _pair(q["id"], clean(node_text(q)), clean(F.coalesce(_text(after), F.lit(""))))

        return F.flatten(F.transform(_nodes(is_outer), lambda b: F.transform(_inside(b, _tag(*inner)), one)))

    if variant == "next":
        after = _next_ids(_tag("p", "div", "dd", "span"))
    else:
        after = _with_next(F.col("nodes"), _tag("p", "div", "span"), lambda n, beside: beside["id"])
    return F.filter(_both(let(after, built)), lambda p: F.size(words(p["question"])) >= n_words)


# ---------------------------------------------------------------- composition

RULES: dict[str, Callable[[], Column]] = {
    "jsonld": jsonld,
    "microdata": microdata,
    "details": details,
    "definition_list": definition_list,
    "heading_next": heading_next,
    "accordion_item": lambda: accordion("item"),
    "accordion": lambda: accordion("any"),
    "table_rows": table_rows,
    "block_sequence": block_sequence,
    "heading_section": heading_section,
    "accordion_trigger": lambda: accordion("trigger"),
    "topic_grid": topic_grid,
    "accordion_expandable": lambda: accordion("expandable"),
    "heading_find_next_p": heading_find_next_p,
    "prefix_sequence": prefix_sequence,
    "container": container,
}
# The rules of the site crawler, in its order.
SITE_RULES = [
    "jsonld", "details", "definition_list", "heading_next", "accordion_item", "accordion", "table_rows",
    "block_sequence", "heading_section", "accordion_trigger", "topic_grid", "accordion_expandable",
]


def qa_rule(dom: DataFrame, rule: str | Column, name: str | None = None) -> DataFrame:
    """Rows (page columns, rule, pos, question, answer) of one rule, given by name or as an expression."""
    kept = [c for c in dom.columns if c not in ("nodes", "pieces")]
    expr = RULES[rule]() if isinstance(rule, str) else rule
    label = name or (rule if isinstance(rule, str) else "custom")
    return dom.select(*kept, F.explode(expr.cast(PAIRS)).alias("p")).select(*kept, F.lit(label).alias("rule"), "p.*")


def extract_qa(
    dom: DataFrame, mode: str = "union", rules: Sequence[str] = tuple(SITE_RULES), compat: bool = False
) -> DataFrame:
    """(page columns, rule, rule_ord, pos, question, answer) of all rules, or of the first rule that yields.

    Structured data is read from the whole page, the other rules from the page without noise. With `compat` it is
    read after scripts and buttons are gone, as the original order of steps had it.
    """
    kept = [c for c in dom.columns if c not in ("nodes", "pieces")]
    structured = [r for r in rules if r in ("jsonld", "microdata")]
    source = dom
    if not compat:
        source = source.withColumns({f"_s_{r}": RULES[r]().cast(PAIRS) for r in structured})
    noise = R.NOISE_TAGS if compat else [t for t in R.NOISE_TAGS if t != "button"]
    clean = drop_noise(source, noise)

    def tagged(i: int, r: str) -> Column:
        found = F.col(f"_s_{r}") if not compat and r in structured else RULES[r]().cast(PAIRS)
        return F.transform(
            found,
            lambda p: F.struct(
                F.lit(r).alias("rule"), F.lit(i).alias("rule_ord"), p["pos"].alias("pos"),
                p["question"].alias("question"), p["answer"].alias("answer"),
            ),
        )

    per_rule = F.array(*[tagged(i, r) for i, r in enumerate(rules)])
    if mode == "union":
        chosen = F.flatten(per_rule)
    elif mode == "first_hit":
        chosen = _first(F.filter(per_rule, lambda a: F.size(a) > 0))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return clean.select(*kept, F.explode(chosen).alias("p")).select(*kept, "p.*")


def page_prefilter(pages: DataFrame, cues: Sequence[str] = tuple(R.PAGE_WORDS), html: str = "html") -> DataFrame:
    """Pages whose markup mentions any of the words. Belongs before the parse: filters do not move below it."""
    low = F.lower(F.col(html))
    test = F.lit(False)
    for cue in cues:
        test = test | F.contains(low, F.lit(cue))
    return pages.filter(test)


def recover_qa_json(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """(columns, pos, question, answer): pairs from text that should hold one JSON object per line.

    Lines count up to the first that is no JSON; from there, the whole text is tried as one JSON list, and if it is
    none, the remaining lines go on counting.
    """
    kept = [c for c in outputs.columns if c != raw]
    text = strip(F.coalesce(F.col(raw), F.lit("")))
    schema = "struct<Q:string,A:string>"

    def obj(j: Column) -> Column:
        keys = F.json_object_keys(j)
        both = F.array_contains(keys, F.lit("Q")) & F.array_contains(keys, F.lit("A"))
        return F.when(both, F.from_json(j, schema))

    def found(rows: Column) -> Column:
        valid = F.transform(rows, lambda s: F.try_parse_json(s).isNotNull())
        bad = F.array_position(valid, F.lit(False))
        whole = F.from_json(text, f"array<string>")
        listed = text.startswith("[") & F.try_parse_json(text).isNotNull()
        head = F.when(bad > 0, F.slice(rows, F.lit(1), (bad - 1).cast("int"))).otherwise(rows)
        good = F.filter(rows, lambda s: F.try_parse_json(s).isNotNull())
        picked = F.when((bad > 0) & listed, F.concat(head, whole)).otherwise(good)
        return F.filter(F.transform(picked, obj), lambda o: o.isNotNull())

    rows = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    return outputs.select(*kept, F.posexplode(let(rows, found)).alias("pos", "o")).select(
        *kept, "pos", F.col("o.Q").alias("question"), F.col("o.A").alias("answer")
    )
