"""Two-database comparison, validation, retrieval and scoring over whole tables."""

import uuid

from pyspark.sql import functions as F

from qaforge.functions import vectors as V
from qaforge.operators import retrieval as RT
from qaforge.operators import tablediff as TD
from qaforge.operators import validation as VL
from qaforge.plans.site_corpus import conversation_pairs
from qaforge.queries.base import (
    DOC_QA_CTE, PAIRS_CTE, cue, cue_sql, doc_qa, keywords_sql, query, table,
)
from qaforge.schemas import COLUMNS_META
from qaforge.session import checkpoint_dir
from qaforge.sources.readers import read_side

# ---------------------------------------------------------------- metadata diff

# Column tables derived from the part table: 4 attributes drawn from its rows, with changes on the second side.
_META1 = """SELECT p_brand AS "table", 'c' || p_partkey AS "column", p_type AS type, CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'NO' END AS nullable,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS "default" FROM part WHERE p_brand <> 'Brand#1' AND p_partkey % 11 <> 0"""
_META2 = """SELECT p_brand AS "table", 'c' || p_partkey AS "column", CASE WHEN p_partkey % 5 = 0 THEN p_type || ' x' ELSE p_type END AS type,
    CASE WHEN p_size % 2 = 0 AND p_partkey % 7 <> 0 THEN 'YES' ELSE 'NO' END AS nullable, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS "default"
    FROM part WHERE p_brand <> 'Brand#2' AND p_partkey % 13 <> 0"""
_META = f"m1 AS ({_META1}), m2 AS ({_META2})"


def _metas(spark, d):
    part = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("c"), k)
    even = size % 2 == 0

    def side(df, kind, nullable, default):
        return df.select(
            F.col("p_brand").alias("table"), name.alias("column"), kind.alias("type"),
            F.when(nullable, "YES").otherwise("NO").alias("nullable"), F.lit("").alias("key"),
            F.when(default, size.cast("string")).alias("default"),
        )

    m1 = side(part.filter((F.col("p_brand") != "Brand#1") & (k % 11 != 0)), F.col("p_type"), even, k % 3 == 0)
    changed = F.when(k % 5 == 0, F.concat("p_type", F.lit(" x"))).otherwise(F.col("p_type"))
    m2 = side(
        part.filter((F.col("p_brand") != "Brand#2") & (k % 13 != 0)), changed, even & (k % 7 != 0), (k % 3 == 0) & (k % 4 != 0)
    )
    assert m1.columns == COLUMNS_META.fieldNames()
    return m1, m2


_COLS = "\"table\", issue, column_or_pk, details, db1_info, db2_info"


@query(
    "diff_tables",
    f"""WITH {_META}, a AS (SELECT DISTINCT "table" FROM m1), b AS (SELECT DISTINCT "table" FROM m2)
    SELECT coalesce(a."table", b."table") AS "table", CASE WHEN a."table" IS NULL THEN 'Missing in db1' ELSE 'Missing in db2' END AS issue,
      '' AS column_or_pk, '' AS details, '' AS db1_info, '' AS db2_info
    FROM a FULL JOIN b ON a."table" = b."table" WHERE a."table" IS NULL OR b."table" IS NULL""",
)
def diff_tables(spark, d):
    return TD.diff_tables(*_metas(spark, d))


_BOTH = f"""{_META}, t AS (SELECT DISTINCT m1."table" FROM m1 JOIN m2 ON m1."table" = m2."table"),
    j AS (SELECT coalesce(x."table", y."table") AS "table", coalesce(x."column", y."column") AS "column", x."column" IS NOT NULL AS has1, y."column" IS NOT NULL AS has2,
      x.type AS t1, y.type AS t2, x.nullable AS n1, y.nullable AS n2, x."default" AS d1, y."default" AS d2
      FROM (SELECT * FROM m1 WHERE "table" IN (SELECT "table" FROM t)) x
      FULL JOIN (SELECT * FROM m2 WHERE "table" IN (SELECT "table" FROM t)) y ON x."table" = y."table" AND x."column" = y."column")"""


@query(
    "diff_columns",
    f"""WITH {_BOTH} SELECT "table", CASE WHEN NOT has1 THEN 'Column missing in db1' ELSE 'Column missing in db2' END AS issue, "column" AS column_or_pk,
      coalesce(CASE WHEN has1 THEN t1 ELSE t2 END, '') AS details, coalesce(CASE WHEN has1 THEN n1 ELSE n2 END, '') AS db1_info, coalesce(CASE WHEN has1 THEN d1 ELSE d2 END, '') AS db2_info
    FROM j WHERE NOT (has1 AND has2)""",
)
def diff_columns(spark, d):
    return TD.diff_columns(*_metas(spark, d))


def _change(label, a, b):
    return f"CASE WHEN {a} IS DISTINCT FROM {b} THEN '{label}: ' || coalesce({a}, 'None') || ' -> ' || coalesce({b}, 'None') END"


_ATTRS = f"""a AS (SELECT "table", "column", t1, t2, concat_ws(', ', {_change('Type', 't1', 't2')}, {_change('Null', 'n1', 'n2')}, {_change('Default', 'd1', 'd2')}) AS details FROM j WHERE has1 AND has2)"""


@query(
    "diff_attributes",
    f"""WITH {_BOTH}, {_ATTRS} SELECT "table", 'Column changed' AS issue, "column" AS column_or_pk, details, t1 AS db1_info, t2 AS db2_info FROM a WHERE details <> ''""",
)
def diff_attributes(spark, d):
    return TD.diff_attributes(*_metas(spark, d))


_KINDS = ["integer", "Character  Varying(20)", "numeric(10, 2)", "bigint  unsigned", "NUMERIC"]


@query(
    "normalize_type",
    f"""WITH k AS (SELECT p_partkey, {cue_sql('p_partkey', _KINDS)} || ' ' || p_type AS t FROM part)
    SELECT p_partkey, regexp_replace(replace(replace(replace(upper(t), 'INTEGER', 'INT'), 'CHARACTER VARYING', 'VARCHAR'), 'NUMERIC', 'DECIMAL'), '\\s+', ' ', 'g') AS kind FROM k""",
)
def normalize_type(spark, d):
    kind = F.concat_ws(" ", cue(F.col("p_partkey"), _KINDS), "p_type")
    return table(spark, d, "part").select("p_partkey", TD.normalize_type(kind).alias("kind"))


# ---------------------------------------------------------------- row diff

_ORDERS2 = """o2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 101 <> 0)"""


def _orders(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    o1 = read_side(spark, d, ["orders"])["orders"].select(*cols)
    k = F.col("o_orderkey")
    o2 = o1.filter(k % 101 != 0).select(
        "o_orderkey", "o_custkey", F.when(k % 89 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )
    return o1, o2


@query(
    "diff_rows",
    f"""WITH {_ORDERS2}, j AS (SELECT o.o_orderkey AS k, o2.o_orderkey AS k2, o.o_orderstatus AS s1, o2.o_orderstatus AS s2, o.o_totalprice AS p1, o2.o_totalprice AS p2, o.o_orderpriority AS r
      FROM orders o LEFT JOIN o2 ON o.o_orderkey = o2.o_orderkey)
    SELECT k, CASE WHEN k2 IS NULL THEN 'Row missing in db2' ELSE 'Content differs' END AS issue,
      coalesce(s1 IS DISTINCT FROM s2 AND k2 IS NOT NULL, false) AS status_changed, coalesce(p1 <> p2, false) AS price_changed,
      k2 IS NOT NULL AND r IS NOT NULL AS priority_gone FROM j
    WHERE k2 IS NULL OR s1 IS DISTINCT FROM s2 OR p1 <> p2 OR r IS NOT NULL""",
)
def diff_rows(spark, d):
    o1, o2 = _orders(spark, d)
    details = F.col("details")
    return TD.diff_rows(o1, o2, "orders", ["o_orderkey"]).select(
        F.col("column_or_pk").cast("long").alias("k"), "issue",
        F.contains(details, F.lit("o_orderstatus: ")).alias("status_changed"),
        F.contains(details, F.lit("o_totalprice: ")).alias("price_changed"),
        F.contains(details, F.lit("o_orderpriority: ")).alias("priority_gone"),
    )


_KEYED = """WITH a AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k, o_orderpriority AS p FROM orders)"""


@query("diff_rows_same", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences FROM orders")
def diff_rows_same(spark, d):
    """A table with null and repeated keys against itself: no difference."""
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderpriority").alias("p"))
    found = TD.diff_rows(rows, rows, "orders", ["k"]).agg(F.count(F.lit(1)).alias("differences"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).join(found, F.lit(True))


@query(
    "diff_rows_keys",
    f"""{_KEYED}, n AS (SELECT k, p, count(*) AS c FROM a GROUP BY ALL)
    SELECT 'Row missing in db1' AS issue, coalesce(k::VARCHAR, '') AS column_or_pk, '' AS details FROM n, range(c) WHERE k IS NULL OR k % 2 = 0""",
)
def diff_rows_keys(spark, d):
    """The same table with null and repeated keys, once whole and once twice over for null and even keys."""
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderpriority").alias("p"))
    more = rows.unionByName(rows.filter("k is null or k % 2 = 0"))
    return TD.diff_rows(rows, more, "orders", ["k"]).select("issue", "column_or_pk", "details")


@query(
    "diff_rows_details",
    """SELECT 'customer' AS "table", 'Content differs' AS issue, CAST(c_custkey AS VARCHAR) AS column_or_pk,
      concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'c_name: ' || c_name || ' -> ' || upper(c_name) || '!' END, CASE WHEN c_custkey % 3 = 0 THEN 'c_nationkey: ' || c_nationkey || ' -> ' || (c_nationkey + 1) END,
        'c_mktsegment: ' || c_mktsegment || ' -> None') AS details, '' AS db1_info, '' AS db2_info FROM customer""",
)
def diff_rows_details(spark, d):
    c1 = read_side(spark, d, ["customer"])["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    c2 = c1.select(
        "c_custkey", F.when(k % 5 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("long").alias("c_nationkey"),
    )
    return TD.diff_rows(c1, c2, "customer", ["c_custkey"])


@query(
    "diff_rows_positional",
    """WITH a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
    b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 4001 <> 4000)),
    j AS (SELECT a.o_orderkey AS k, concat_ws('; ', CASE WHEN a.o_orderkey <> b.o_orderkey THEN 'o_orderkey: ' || a.o_orderkey || ' -> ' || b.o_orderkey END,
      CASE WHEN a.o_custkey <> b.o_custkey THEN 'o_custkey: ' || a.o_custkey || ' -> ' || b.o_custkey END) AS details FROM a JOIN b ON a.i = b.i)
    SELECT 'orders' AS "table", 'Content differs' AS issue, CAST(k AS VARCHAR) AS column_or_pk, details, '' AS db1_info, '' AS db2_info FROM j WHERE details <> ''""",
)
def diff_rows_positional(spark, d):
    o1 = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    o2 = o1.filter(k % 4001 != 4000).withColumn("o_custkey", F.when(k % 31 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return TD.diff_rows(o1, o2, "orders", ["o_orderkey"], mode="positional")


@query(
    "diff_rows_multiset",
    """WITH a AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL),
    b AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem WHERE l_orderkey % 500 <> 0 GROUP BY ALL)
    SELECT 'lineitem' AS "table", 'Row copies differ' AS issue, '' AS column_or_pk,
      'l_returnflag: ' || a.l_returnflag || '; l_linestatus: ' || a.l_linestatus || '; q: ' || a.q || ' | ' || a.n || ' -> ' || coalesce(b.n, 0) AS details,
      CAST(a.n AS VARCHAR) AS db1_info, CAST(coalesce(b.n, 0) AS VARCHAR) AS db2_info
    FROM a LEFT JOIN b ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.q = b.q WHERE a.n <> coalesce(b.n, 0)""",
)
def diff_rows_multiset(spark, d):
    rows = table(spark, d, "lineitem")
    cols = ["l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q")]
    return TD.diff_rows(rows.select(*cols), rows.filter("l_orderkey % 500 <> 0").select(*cols), "lineitem", mode="multiset")


@query(
    "diff_counts",
    """SELECT 'orders' AS "table", 'Content row count differs' AS issue, '' AS column_or_pk,
      count(*) || ' rows in db1 -> ' || count(*) FILTER (WHERE o_orderkey % 101 <> 0) || ' rows in db2' AS details, '' AS db1_info, '' AS db2_info FROM orders""",
)
def diff_counts(spark, d):
    o1, o2 = _orders(spark, d)
    return TD.diff_counts(o1, o2, "orders")


@query(
    "diff_summary",
    f"""WITH {_BOTH}, {_ATTRS}, {_ORDERS2}
    SELECT 'Missing Tables' AS metric, (SELECT count(*) FROM (SELECT DISTINCT "table" FROM m1) a FULL JOIN (SELECT DISTINCT "table" FROM m2) b ON a."table" = b."table" WHERE a."table" IS NULL OR b."table" IS NULL) AS count
    UNION ALL SELECT 'Missing Columns', (SELECT count(*) FROM j WHERE NOT (has1 AND has2))
    UNION ALL SELECT 'Changed Columns', (SELECT count(*) FROM a WHERE details <> '')
    UNION ALL SELECT 'Content Differences', (SELECT count(*) FROM orders)""",
)
def diff_summary(spark, d):
    m1, m2 = _metas(spark, d)
    o1, o2 = _orders(spark, d)
    # Every order counts once: those left out on the second side, and the rest for the column it lacks.
    rows = TD.diff_rows(o1, o2, "orders", ["o_orderkey"])
    report = TD.diff_tables(m1, m2).unionByName(TD.diff_columns(m1, m2)).unionByName(TD.diff_attributes(m1, m2)).unionByName(rows)
    return TD.diff_summary(report)


# The second side lacks some orders, has others with another price, and one twice.
_CHANGED = """b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 397 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 401 <> 0)"""


def _changed(spark, d):
    o1 = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    return o1, o1.filter(k % 401 != 0).withColumn("o_totalprice", F.when(k % 397 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


@query(
    "diff_changed_rows",
    f"""WITH {_CHANGED} SELECT CAST(o.o_orderkey AS VARCHAR) AS column_or_pk, CASE WHEN b.o_orderkey IS NULL THEN 'Row missing in db2' ELSE 'Content differs' END AS issue
    FROM orders o LEFT JOIN b ON o.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR b.o_totalprice <> o.o_totalprice""",
)
def diff_changed_rows(spark, d):
    """Mostly equal tables: only the key ranges that differ are compared row by row."""
    return TD.diff_changed_rows(*_changed(spark, d), "orders", ["o_orderkey"]).select("column_or_pk", "issue")


@query("diff_changed_rows_same", "SELECT CAST(0 AS BIGINT) AS left_rows, CAST(0 AS BIGINT) AS right_rows, count(*) AS n_rows FROM lineitem")
def diff_changed_rows_same(spark, d):
    """A table with repeated keys against itself: no range is left to compare."""
    rows = table(spark, d, "lineitem")
    # The other side is dealt anew, into as many parts as its size asks for.
    l, r = TD.changed_rows(rows, rows.hint("rebalance"), ["l_orderkey"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(l.count()).alias("left_rows"), F.lit(r.count()).alias("right_rows"), "n_rows")


@query("diff_report")
def diff_report(spark, d):
    one = read_side(spark, d, ["nation", "region", "orders", "supplier"])
    two = {"nation": one["nation"].drop("n_regionkey"), "orders": _orders(spark, d)[1], "supplier": one["supplier"], "customer": one["region"]}
    return TD.diff_report(one, two, {"nation": ["n_nationkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"]})


# ---------------------------------------------------------------- validation

_FAULTS = [None, "invalid JSON", "JSON object expected", "messages must be a list of at least two", "invalid or missing role",
           "content must be a non-empty string", "message must be an object", "content must be a non-empty string"]


def _lines(spark, d):
    """One training record per document, with a fault drawn by its number."""
    i = F.col("doc_id") % len(_FAULTS)
    text = F.col("text")

    def msg(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    good = F.array(msg("system", F.lit("s")), msg("user", text), msg("assistant", text))

    def record(messages):
        return F.to_json(F.struct(messages.alias("messages")))

    line = (
        F.when(i == 1, F.concat(F.lit("{"), F.col("source")))
        .when(i == 2, F.to_json(F.array(F.col("source"))))
        .when(i == 3, record(F.array(msg("user", text))))
        .when(i == 4, record(F.array(msg("system", F.lit("s")), msg("tool", text), msg("assistant", text))))
        .when(i == 5, record(F.array(msg("system", F.lit("s")), msg("user", F.lit(" ")), msg("assistant", text))))
        .when(i == 6, F.lit('{"messages": [{"role": "user", "content": "x"}, 7]}'))
        .when(i == 7, F.lit('{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": 7}]}'))
        .otherwise(record(good))
    )
    return table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line"), line.alias("value"))


_err = f"{cue_sql('doc_id', [f or '' for f in _FAULTS])}"
_ERRORS = f"""errors AS (SELECT source AS file, doc_id AS line, CASE WHEN doc_id % 8 IN (4, 5, 6, 7) THEN 2 ELSE 0 END AS msg_no, {_err} AS error FROM documents WHERE doc_id % 8 <> 0)"""


@query("validate_strict", f"WITH {_ERRORS} SELECT file, line, CAST(msg_no AS BIGINT) AS msg_no, error FROM errors")
def validate_strict(spark, d):
    return VL.validate_strict(_lines(spark, d))


@query("validate_roles", "SELECT source AS file, doc_id AS line, doc_id % 8 IN (0, 5) AS ok FROM documents")
def validate_roles(spark, d):
    return VL.validate_roles(_lines(spark, d)).select("file", "line", "ok")


@query(
    "file_verdict",
    f"WITH {_ERRORS}, e AS (SELECT file, arg_min(error, line) AS first_error FROM errors GROUP BY file) SELECT DISTINCT d.source AS file, first_error IS NULL AS ok, first_error FROM documents d LEFT JOIN e ON d.source = e.file",
)
def file_verdict(spark, d):
    lines = _lines(spark, d)
    return VL.file_verdict(lines, VL.validate_strict(lines))


# Training files, one per source, with a blank line before every tenth document.
_FILE_LINES = """placed AS (SELECT *, row_number() OVER w + count(*) FILTER (WHERE doc_id % 10 = 0) OVER w AS line FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
    errors AS (SELECT source AS file, line, CASE WHEN doc_id % 8 IN (4, 5, 6, 7) THEN 2 ELSE 0 END AS msg_no, {err} AS error FROM placed WHERE doc_id % 8 <> 0)"""


def _validated(spark, d):
    at = f"{checkpoint_dir(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    lines = _lines(spark, d)
    # One file per source, in order of the documents; a blank line comes before its record.
    whole = lines.select("file", "line", F.posexplode(F.when(F.col("line") % 10 == 0, F.array(F.lit(""), "value")).otherwise(F.array("value"))).alias("p", "value"))
    whole.repartition("file").sortWithinPartitions("file", "line", "p").select("file", "value").write.partitionBy("file").text(at)
    errors, verdicts = VL.validate_files(spark, at)
    name = F.regexp_extract("file", "file=([^/]+)/", 1)
    return errors.withColumn("file", name), verdicts.withColumn("file", name)


@query("validate_files", f"WITH {_FILE_LINES.format(err=_err)} SELECT file, line, CAST(msg_no AS BIGINT) AS msg_no, error FROM errors")
def validate_files(spark, d):
    """Records are written to files and read back by file and line."""
    return _validated(spark, d)[0]


@query("validate_files_verdict", f"""WITH {_FILE_LINES.format(err=_err)}, e AS (SELECT file, arg_min(error, line) AS first_error FROM errors GROUP BY file)
    SELECT DISTINCT d.source AS file, first_error IS NULL AS ok, first_error FROM documents d LEFT JOIN e ON d.source = e.file""")
def validate_files_verdict(spark, d):
    return _validated(spark, d)[1]


ROLE_SETS = [["system", "user", "assistant"], ["user", "assistant"], ["user", "system", "assistant"]]


def _records(spark, d):
    """Conversation pairs as chat records of three kinds."""
    pairs = conversation_pairs(table(spark, d, "conversations"))
    content = {"system": F.lit("s"), "user": F.col("question"), "assistant": F.col("answer")}
    kinds = [F.array(*[F.struct(F.lit(r).alias("role"), content[r].alias("content")) for r in roles]) for roles in ROLE_SETS]
    k = F.col("conv_id") % 3
    return pairs.withColumn("messages", F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).otherwise(kinds[2]))


@query("validate_exact_roles", f"WITH {PAIRS_CTE} SELECT conv_id, turn, conv_id % 3 = 0 AS ok FROM pairs")
def validate_exact_roles(spark, d):
    return VL.validate_exact_roles(_records(spark, d)).select("conv_id", "turn", "ok")


@query(
    "length_warnings",
    f"WITH {PAIRS_CTE}, n AS (SELECT conv_id, turn, length(question) + length(answer) + CASE WHEN conv_id % 3 = 1 THEN 0 ELSE 1 END AS total_length FROM pairs) SELECT * FROM n WHERE total_length > 900",
)
def length_warnings(spark, d):
    return VL.length_warnings(_records(spark, d), 900).select("conv_id", "turn", "total_length")


@query(
    "size_tier",
    """WITH n AS (SELECT file, count(*) AS n_rows FROM (SELECT source AS file FROM documents UNION ALL SELECT event_type FROM events UNION ALL SELECT 'nation' || s_nationkey FROM supplier UNION ALL SELECT 'segment' || c_nationkey % 3 FROM customer) GROUP BY file)
    SELECT file, n_rows, CAST(CASE WHEN n_rows < 50 THEN 10 WHEN n_rows < 300 THEN 6 WHEN n_rows < 1000 THEN 5 ELSE 3 END AS BIGINT) AS n_epochs,
      CAST(CASE WHEN n_rows < 50 THEN 1 WHEN n_rows < 300 THEN 2 WHEN n_rows < 1000 THEN 4 ELSE 8 END AS BIGINT) AS batch_size,
      CAST(CASE WHEN n_rows < 50 THEN 0.3 WHEN n_rows < 300 THEN 0.25 WHEN n_rows < 1000 THEN 0.2 ELSE 0.15 END AS DOUBLE) AS lr_multiplier FROM n""",
)
def size_tier(spark, d):
    files = (
        table(spark, d, "documents").select(F.col("source").alias("file"))
        .unionAll(table(spark, d, "events").select("event_type"))
        .unionAll(table(spark, d, "supplier").select(F.concat(F.lit("nation"), "s_nationkey")))
        .unionAll(table(spark, d, "customer").select(F.concat(F.lit("segment"), F.col("c_nationkey") % 3)))
    )
    return VL.size_tier(files)


# ---------------------------------------------------------------- retrieval and scores

_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


def _top_sql(k, other):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, {_COS} AS score FROM embeddings q, embeddings c{' WHERE q.vec_id <> c.vec_id' if other else ''}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT query_id, rank, item_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _vectors(spark, d, name="item_id"):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(name), "embedding")


@query("top_k", _top_sql(5, False))
def top_k(spark, d):
    hits = RT.top_k(_vectors(spark, d, "query_id"), _vectors(spark, d), 5)
    return hits.withColumn("score", F.round("score", 6))


@query("top_k_blocks", _top_sql(2, False))
def top_k_blocks(spark, d):
    """The same search by blocks, as for query sets too large to broadcast."""
    hits = RT.top_k(_vectors(spark, d, "query_id"), _vectors(spark, d), 2, bound=0, block=512)
    return hits.withColumn("score", F.round("score", 6))


@query("nearest_others", _top_sql(3, True))
def nearest_others(spark, d):
    hits = RT.nearest_others(_vectors(spark, d), _vectors(spark, d), 3)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "pair_similarity",
    f"""WITH p AS (SELECT q.vec_id, {_COS} * 4 AS score FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1),
    s AS (SELECT q.vec_id, {_COS} AS score FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1)
    SELECT s.vec_id, round(s.score, 6) AS score, CASE WHEN s.score > 0.80 THEN 'same' WHEN s.score > 0.6 THEN 'related' ELSE 'different' END AS verdict,
      CASE WHEN p.score > 0.80 THEN 'same' WHEN p.score > 0.6 THEN 'related' ELSE 'different' END AS scaled FROM s JOIN p ON s.vec_id = p.vec_id""",
)
def pair_similarity(spark, d):
    v = _vectors(spark, d, "vec_id")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = RT.pair_similarity(v.join(nxt, "vec_id"), "embedding", "other")
    return out.select("vec_id", F.round("score", 6).alias("score"), "verdict", V.pair_verdict(F.col("score") * 4).alias("scaled"))


_SCORED = f"""{PAIRS_CTE}, k AS (SELECT conv_id, turn, question, answer, list_distinct({keywords_sql('question')}) AS a, list_distinct({keywords_sql('answer')}) AS b FROM pairs),
    j AS (SELECT *, len(list_filter(a, lambda x: list_contains(b, x))) AS i FROM k),
    scored AS (SELECT conv_id, turn, question, answer, CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i) ELSE 0 END + least(length(answer) / 600.0::DOUBLE, 0.3::DOUBLE) AS score FROM j)"""


@query("score_response", f"WITH {_SCORED} SELECT conv_id, turn, md5(question) AS q, round(score, 6) AS score FROM scored")
def score_response(spark, d):
    pairs = conversation_pairs(table(spark, d, "conversations"))
    return pairs.select(
        "conv_id", "turn", F.md5("question").alias("q"),
        F.round(RT.score_response(F.col("question"), F.col("answer")), 6).alias("score"),
    )


@query(
    "best_of_n",
    """SELECT l_partkey AS query_id, l_orderkey, l_linenumber, l_extendedprice AS score,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem""",
)
def best_of_n(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("query_id"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
    )
    return RT.best_of_n(c).drop("arrival")


@query(
    "best_candidate",
    """SELECT l_partkey AS query_id, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) = 1""",
)
def best_candidate(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
    )
    return RT.best_candidate(c)


_D, _P, _I = ["ing", "tion", "que", "der"], ["the", "und", "les"], ["ent", "ion", "x-y"]


@query(
    "evaluate",
    f"""WITH {PAIRS_CTE}, v AS (SELECT *, [{cue_sql('conv_id', _D)}, {cue_sql('turn', _D)}, {cue_sql('conv_id', _P)}, {cue_sql('conv_id', _I)}] AS want,
      answer || CASE WHEN conv_id % 2 = 0 THEN ' certain' ELSE '' END AS r FROM pairs)
    SELECT conv_id, turn, md5(question) AS q, round(len(list_filter(want, lambda w: contains(r, w))) / 4, 6) AS completeness,
      round(least(length(r) / 100.0::DOUBLE + CASE WHEN contains(r, 'confident') OR contains(r, 'certain') THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence FROM v""",
)
def evaluate(spark, d):
    c = F.col("conv_id")
    rows = conversation_pairs(table(spark, d, "conversations")).withColumns(
        {
            "dom": F.array(cue(c, _D), cue(F.col("turn"), _D)), "per": F.array(cue(c, _P)), "int": cue(c, _I),
            "r": F.concat("answer", F.when(c % 2 == 0, " certain").otherwise("")),
        }
    )
    out = RT.evaluate(rows, "r", "dom", "per", "int")
    return out.select(
        "conv_id", "turn", F.md5("question").alias("q"), F.round("completeness", 6).alias("completeness"), F.round("confidence", 6).alias("confidence")
    )


@query(
    "pick_candidates",
    """WITH c AS (SELECT DISTINCT o_custkey AS query_id, o_orderpriority AS model_key FROM orders),
    r AS (SELECT *, CASE model_key WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 END AS pos FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST, model_key) AS place FROM r)
    SELECT query_id, model_key, place FROM n WHERE pos IS NOT NULL OR place <= 3""",
)
def pick_candidates(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("model_key")).distinct()
    return RT.pick_candidates(c, ["5-LOW", "2-HIGH"], 3)


@query("search_qa", f"WITH {DOC_QA_CTE} SELECT pos, question, answer FROM qa WHERE contains(lower(question), 'the') AND length(answer) >= 20")
def search_qa(spark, d):
    return RT.search_qa(doc_qa(spark, d), "The").select("pos", "question", "answer")


@query(
    "lookup_answer",
    f"""WITH {DOC_QA_CTE}, f AS (SELECT question, arg_min(answer, pos) AS f, arg_max(answer, pos) AS l FROM qa GROUP BY question),
    a AS (SELECT pos, CASE WHEN pos % 2 = 0 THEN question ELSE question || '!' END AS question FROM qa)
    SELECT a.pos, a.question, coalesce(f.f, 'Not found') AS answer, coalesce(f.l, 'Not found') AS last_answer FROM a LEFT JOIN f ON a.question = f.question""",
)
def lookup_answer(spark, d):
    qa = doc_qa(spark, d)
    # Every other question is changed, so that some are not found.
    other = F.when(F.col("pos") % 2 == 0, F.col("question")).otherwise(F.concat("question", F.lit("!")))
    asked = qa.select("pos", other.alias("question"))
    first = RT.lookup_answer(asked, qa)
    last = RT.lookup_answer(asked, qa, keep="last")
    return first.join(last.select("pos", F.col("answer").alias("last_answer")), "pos")
