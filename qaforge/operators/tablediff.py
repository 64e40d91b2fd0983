"""Comparison of two databases: tables, columns, attributes, row counts and row contents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.operators.ranking import row_number_by
from qaforge.schemas import COLUMNS_META, DIFF_REPORT
from qaforge.session import cut_lineage

METRICS = ["Missing Tables", "Missing Columns", "Changed Columns", "Content Differences"]


def normalize_type(col: Column) -> Column:
    """Upper-case type name with the common synonyms replaced and single spaces."""
    out = F.upper(col)
    for a, b in (("INTEGER", "INT"), ("CHARACTER VARYING", "VARCHAR"), ("NUMERIC", "DECIMAL")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\s+", " ")


def columns_meta(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[tuple[str, str], str] | None = None,
) -> DataFrame:
    """Column table of a set of DataFrames, from their schemas (metadata only, no rows are read)."""
    keys, defaults = keys or {}, defaults or {}
    rows = [
        (
            name, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO",
            "PRI" if f.name in keys.get(name, ()) else "", defaults.get((name, f.name)),
        )
        for name, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, COLUMNS_META)


def _report(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols[f.name].cast("string").alias(f.name) for f in DIFF_REPORT.fields])


def diff_tables(meta1: DataFrame, meta2: DataFrame) -> DataFrame:
    """Report rows for tables found on one side only."""
    a = meta1.select("table").distinct().withColumn("_1", F.lit(True))
    b = meta2.select("table").distinct().withColumn("_2", F.lit(True))
    one = a.join(b, "table", "full_outer").filter("_1 is null or _2 is null")
    return _report(
        one, table=F.col("table"), issue=F.when(F.col("_1").isNull(), "Missing in db1").otherwise("Missing in db2"),
        column_or_pk=F.lit(""), details=F.lit(""), db1_info=F.lit(""), db2_info=F.lit(""),
    )


def _side_by_side(meta1: DataFrame, meta2: DataFrame) -> DataFrame:
    """All columns of the tables both sides have, with the attributes of either side."""
    attrs = ["type", "nullable", "default"]
    both = meta1.select("table").distinct().join(meta2.select("table").distinct(), "table", "left_semi")

    def side(meta: DataFrame, n: int) -> DataFrame:
        return meta.join(both, "table", "left_semi").select(
            "table", "column", F.lit(True).alias(f"_{n}"), *[F.col(a).alias(f"{a}{n}") for a in attrs]
        )

    return side(meta1, 1).join(side(meta2, 2), ["table", "column"], "full_outer")


def diff_columns(meta1: DataFrame, meta2: DataFrame) -> DataFrame:
    """Report rows for columns on one side only: type, nullability and default of the side that has it."""
    rows = _side_by_side(meta1, meta2).filter("_1 is null or _2 is null")
    absent = F.col("_1").isNull()

    def own(name: str) -> Column:
        return F.coalesce(F.when(absent, F.col(f"{name}2")).otherwise(F.col(f"{name}1")), F.lit(""))

    return _report(
        rows, table=F.col("table"),
        issue=F.when(absent, "Column missing in db1").otherwise("Column missing in db2"),
        column_or_pk=F.col("column"), details=own("type"), db1_info=own("nullable"), db2_info=own("default"),
    )


def diff_attributes(meta1: DataFrame, meta2: DataFrame, normalize: bool = False) -> DataFrame:
    """Report rows for columns whose type, nullability or default differ."""
    rows = _side_by_side(meta1, meta2).filter("_1 and _2")
    if normalize:
        rows = rows.withColumns({"type1": normalize_type(F.col("type1")), "type2": normalize_type(F.col("type2"))})

    def change(label: str, name: str) -> Column:
        x, y = F.col(f"{name}1"), F.col(f"{name}2")
        shown = F.concat(F.lit(f"{label}: "), F.coalesce(x, F.lit("None")), F.lit(" -> "), F.coalesce(y, F.lit("None")))
        return F.when(~x.eqNullSafe(y), shown)

    details = F.concat_ws(", ", change("Type", "type"), change("Null", "nullable"), change("Default", "default"))
    changed = rows.withColumn("_d", details).filter("_d <> ''")
    return _report(
        changed, table=F.col("table"), issue=F.lit("Column changed"), column_or_pk=F.col("column"),
        details=F.col("_d"), db1_info=F.col("type1"), db2_info=F.col("type2"),
    )


def diff_counts(t1: DataFrame, t2: DataFrame, table: str) -> DataFrame:
    """One report row if the row counts differ, none otherwise."""
    sides = t1.select(F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(t2.select(F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    n = sides.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n2")).filter("n1 <> n2")
    return _report(
        n, table=F.lit(table), issue=F.lit("Content row count differs"), column_or_pk=F.lit(""),
        details=F.concat(F.col("n1"), F.lit(" rows in db1 -> "), F.col("n2"), F.lit(" rows in db2")),
        db1_info=F.lit(""), db2_info=F.lit(""),
    )


def _shown(col: Column, kind: T.DataType) -> Column:
    """Value as text. Doubles keep plain digits where a short form would use an exponent; null reads None."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # From ten million on the plain cast prints an exponent.
        digits = F.regexp_replace(F.format_string("%.6f", col.cast("double")), r"(\.\d+?)0+$", "$1")
        text = F.when((F.abs(col) >= 1e7) & (F.abs(col) < 1e15), digits).otherwise(col.cast("string"))
        return F.coalesce(text, F.lit("None"))
    return F.coalesce(col.cast("string"), F.lit("None"))


def _differs(x: Column, y: Column, kx: T.DataType, ky: T.DataType) -> Column:
    """Not equal, null-safe, in a type both sides fit: numbers compare as numbers, the rest as text."""
    if kx == ky:
        return ~x.eqNullSafe(y)
    numeric = isinstance(kx, T.NumericType) and isinstance(ky, T.NumericType)
    if numeric:
        return ~x.cast("double").eqNullSafe(y.cast("double"))
    return ~x.cast("string").eqNullSafe(y.cast("string"))


def _compare(pairs: DataFrame, t1: DataFrame, t2: DataFrame, skip: Sequence[str]) -> Column:
    """Text `col: old -> new; …` over the first side's columns; `pairs` has structs `_l` and `_r`."""
    kinds2 = {f.name: f.dataType for f in t2.schema.fields}
    parts = []
    for f in t1.schema.fields:
        if f.name in skip:
            continue
        x = F.col("_l")[f.name]
        if f.name in kinds2:
            y, ky = F.col("_r")[f.name], kinds2[f.name]
            test, shown = _differs(x, y, f.dataType, ky), _shown(y, ky)
        else:
            test, shown = x.isNotNull(), F.lit("None")
        parts.append(F.when(test, F.concat(F.lit(f"{f.name}: "), _shown(x, f.dataType), F.lit(" -> "), shown)))
    return F.concat_ws("; ", *parts)


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def _same(by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in by])


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    """64 bits of the values as text, null apart from empty text and each in its place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])


def _pairs_by_key(t1: DataFrame, t2: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(names, _l, _r): rows of both sides paired by key; null keys are equal, and a row without a partner has null beside it.

    Where no key repeats, this is one join. Else equal rows of a key are paired first, what is left in order of its contents. Equal rows are counted and not
    numbered, before they meet: a row held a million times is one row per task.
    """
    keys = [F.col(k).alias(n) for k, n in zip(key, names)]
    counted = t1.select(*keys, F.lit(1).alias("_1"), F.lit(0).alias("_2")).unionAll(t2.select(*keys, F.lit(0).alias("_1"), F.lit(1).alias("_2")))
    most = counted.groupBy(*names).agg(F.greatest(F.sum("_1"), F.sum("_2")).alias("n")).agg(F.max("n")).first()[0] or 0
    either = [F.coalesce(F.col(f"l.{n}"), F.col(f"r.{n}")).alias(n) for n in names]
    if most <= 1:
        l, r = (t.select(*keys, _row(t).alias(side)).alias(side[1:]) for t, side in ((t1, "_l"), (t2, "_r")))
        return l.join(r, _same(names), "full_outer").select(*either, "_l", "_r")

    shared = [c for c in t1.columns if c in t2.columns]
    own = [c for c in t1.columns if c not in shared]
    digest = [_row_hash(shared, i).alias(f"_h{i}") for i in (1, 2)]
    match = [*names, "_h1", "_h2"]

    def copies(t: DataFrame, side: str) -> DataFrame:
        rows = t.groupBy(*[F.col(f"`{c}`") for c in t.columns]).agg(F.count(F.lit(1)).alias("_n"))
        return rows.select(*keys, *digest, _row_hash(t.columns, 3).alias("_g"), F.struct(*[F.col(f"`{c}`") for c in t.columns]).alias(side), "_n")

    l, r = copies(t1, "_l"), copies(t2.select(*[F.col(f"`{c}`") for c in shared]), "_r")
    if own:
        # Rows that agree in the shared columns take the copies of the other side in turn.
        w = Window.partitionBy(*match)
        l = l.withColumn("_before", F.sum("_n").over(w.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(w))
    else:
        l = l.withColumn("_before", F.lit(0).cast("long")).withColumn("_all", F.col("_n"))
    zero = F.lit(0).cast("long")
    before, n1, n2 = F.coalesce("_before", zero), F.coalesce(F.col("l._n"), zero), F.coalesce(F.col("r._n"), zero)
    equal = F.greatest(F.least(n1, n2 - before), zero)
    met = l.alias("l").join(r.alias("r"), _same(match), "full_outer").select(
        *either, F.coalesce("l._h1", "r._h1").alias("_h1"), F.coalesce("l._h2", "r._h2").alias("_h2"), F.coalesce("l._g", "r._g").alias("_g"), "_l", "_r", equal.alias("_equal"),
        (n1 - equal).alias("_left"), F.when(before == 0, F.greatest(n2 - F.coalesce("_all", zero), zero)).otherwise(zero).alias("_right"))
    # Pairs of equal rows say something only if the first side has columns of its own.
    told = F.lit(False) if not own else (F.col("_equal") > 0) & reduce(lambda x, y: x | y, [F.col("_l")[c].isNotNull() for c in own])
    met = cut_lineage(met.filter((F.col("_left") > 0) | (F.col("_right") > 0) | told))

    def surplus(side: str, count: str) -> DataFrame:
        rows = met.filter(F.col(count) > 0).select(*names, "_h1", "_h2", "_g", side, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))).alias("_copy"))
        return row_number_by(rows, names, [F.col(c) for c in ("_h1", "_h2", "_g", "_copy")], "_no").select(*names, "_no", side)

    rest = surplus("_l", "_left").alias("l").join(surplus("_r", "_right").alias("r"), _same([*names, "_no"]), "full_outer").select(*either, "_l", "_r")
    if not own:
        return rest
    pairs = met.filter(told).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_equal"))))
    return rest.unionByName(pairs.select(*names, "_l", "_r"))


RANGES = (1024, 256)  # equal ranges of the key's span at each level


def changed_rows(t1: DataFrame, t2: DataFrame, key: Sequence[str], levels: Sequence[int] = RANGES) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in key ranges which differ.

    The span of the first key column is cut into ranges, each range of either side is summed up as its row count and sums of row hashes, and only
    ranges with unequal sums are looked at more closely, level by level. Sums are combined before the shuffle: of equal tables no row moves. Keys that are
    no numbers are cut by hash, whole numbers by value, so that unchanged ranges need not be read where the files are in order of the key.
    """
    first = key[0]
    shared = [c for c in t1.columns if c in t2.columns]
    own = [c for c in t1.columns if c not in shared]
    kinds = [t.schema[first].dataType for t in (t1, t2)]
    whole = all(isinstance(k, T.IntegralType) for k in kinds)
    if whole:
        ends = [t.agg(F.min(first), F.max(first)).first() for t in (t1, t2)]
        low, high = (pick((e[i] for e in ends if e[i] is not None), default=0) for i, pick in enumerate((min, max)))
        place, size = F.col(first).cast("decimal(38,0)") - low, high - low + 1
    else:
        place, size = F.pmod(F.xxhash64(F.col(first).cast("string")), F.lit(1 << 40)).cast("decimal(38,0)"), 1 << 40
    sides = [t1, t2]
    for parts in levels:
        size = max(1, -(-size // parts))
        bucket = F.when(F.col(first).isNull(), F.lit(-1)).otherwise(F.floor(place / size)).cast("long")

        def summed(t: DataFrame, n: int, bucket: Column = bucket) -> DataFrame:
            extra = reduce(lambda x, y: x | y, [F.col(f"`{c}`").isNotNull() for c in own]) if own and n == 1 else F.lit(False)
            return t.groupBy(bucket.alias("_b")).agg(F.struct(
                F.count(F.lit(1)), F.sum(_row_hash(shared, 1).cast("decimal(20,0)")), F.bit_xor(_row_hash(shared, 2)), F.max(extra)).alias(f"_s{n}"))

        found = summed(sides[0], 1).join(summed(sides[1], 2), "_b", "full_outer").filter(~F.col("_s1").eqNullSafe(F.col("_s2"))).select("_b").collect()
        changed = sorted(r["_b"] for r in found)  # a number per range, at most the product of the levels
        if not changed:
            return t1.limit(0), t2.limit(0)
        near = bucket.isin(changed)
        if whole:
            near = near & _spans(F.col(first), changed, low, size)
        sides = [t.filter(near) for t in (t1, t2)]
    return sides[0], sides[1]


def _spans(col: Column, buckets: Sequence[int], low: int, size: int, most: int = 32) -> Column:
    """Condition on the column itself, which a scan can use to leave out files: at most `most` stretches that cover the buckets."""
    known = [b for b in buckets if b >= 0]
    gaps = sorted(sorted(range(1, len(known)), key=lambda i: known[i - 1] - known[i])[: most - 1])
    parts = [known[a:b] for a, b in zip([0, *gaps], [*gaps, len(known)]) if b > a]
    test = F.lit(False)
    for part in parts:
        test = test | ((col >= low + part[0] * size) & (col < low + (part[-1] + 1) * size))
    return test | col.isNull() if -1 in buckets else test


def diff_changed_rows(t1: DataFrame, t2: DataFrame, table: str, key: Sequence[str], levels: Sequence[int] = RANGES) -> DataFrame:
    """What `diff_rows` reports by key, for tables that are mostly equal: only rows of differing key ranges are shuffled."""
    return diff_rows(*changed_rows(t1, t2, key, levels), table, key)


def diff_rows(
    t1: DataFrame, t2: DataFrame, table: str, key: Sequence[str] = (), mode: str = "key"
) -> DataFrame:
    """Report rows for differing contents.

    `key` pairs rows on all key columns and tells missing rows; `positional` sorts both sides by the key and pairs
    them by place, as a row-by-row read would; `multiset` needs no key and lists rows with unequal copies.
    """
    blank = F.lit("")
    if mode == "key":
        names = [f"_k{i}" for i in range(len(key))]
        joined = _pairs_by_key(t1, t2, key, names)
        pk = F.concat_ws(",", *[F.col(n).cast("string") for n in names])
        issue = (
            F.when(F.col("_r").isNull(), "Row missing in db2")
            .when(F.col("_l").isNull(), "Row missing in db1")
            .otherwise("Content differs")
        )
        both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
        rows = joined.withColumn("_d", F.when(both, _compare(joined, t1, t2, key)).otherwise(""))
        rows = rows.filter(~both | (F.col("_d") != ""))
        return _report(rows, table=F.lit(table), issue=issue, column_or_pk=pk, details=F.col("_d"), db1_info=blank, db2_info=blank)
    if mode == "positional":
        # Without a key the rows are ordered by all shared columns.
        by = list(key) or [c for c in t1.columns if c in t2.columns]
        order1, order2 = [F.col(k) for k in by], [F.col(k) for k in by]
        l = _numbered(t1, order1).select("_no", _row(t1).alias("_l"))
        r = _numbered(t2, order2).select("_no", _row(t2).alias("_r"))
        rows = l.join(r, "_no")
        rows = rows.withColumn("_d", _compare(rows, t1, t2, ())).filter("_d <> ''")
        pk = F.concat_ws(",", *[F.col("_l")[k].cast("string") for k in key[:1]]) if key else blank
        return _report(rows, table=F.lit(table), issue=F.lit("Content differs"), column_or_pk=pk, details=F.col("_d"), db1_info=blank, db2_info=blank)
    if mode == "multiset":
        cols = [c for c in t1.columns if c in t2.columns]

        def counted(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))

        # Copies are counted before they meet, so a row held a billion times costs one row per task.
        l, r = counted(t1, "_n1").alias("l"), counted(t2, "_n2").alias("r")
        on = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols])
        rows = l.join(r, on, "full_outer").select(
            *[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in cols],
            F.coalesce("_n1", F.lit(0)).alias("_n1"), F.coalesce("_n2", F.lit(0)).alias("_n2"),
        ).filter("_n1 <> _n2")
        text = F.concat_ws("; ", *[F.concat(F.lit(f"{f.name}: "), _shown(F.col(f.name), f.dataType)) for f in t1.schema.fields if f.name in cols])
        copies = F.concat(F.col("_n1"), F.lit(" -> "), F.col("_n2"))
        return _report(rows, table=F.lit(table), issue=F.lit("Row copies differ"), column_or_pk=blank, details=F.concat(text, F.lit(" | "), copies), db1_info=F.col("_n1"), db2_info=F.col("_n2"))
    raise ValueError(f"unknown mode: {mode}")


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number all rows by order without sorting them in one task."""
    by = list(order) or [F.lit(0)]
    return row_number_by(df.withColumn("_all", F.lit(1)), ["_all"], by, "_no", max_group=0).drop("_all")


def diff_report(
    tables1: Mapping[str, DataFrame], tables2: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None,
    meta1: DataFrame | None = None, meta2: DataFrame | None = None, mode: str = "positional",
) -> DataFrame:
    """Full report over two databases. Contents are compared only where the row counts agree (positional mode)."""
    spark = next(iter(tables1.values())).sparkSession
    keys = keys or {}
    meta1 = meta1 if meta1 is not None else columns_meta(spark, tables1, keys)
    meta2 = meta2 if meta2 is not None else columns_meta(spark, tables2, keys)
    parts = [diff_tables(meta1, meta2), diff_columns(meta1, meta2), diff_attributes(meta1, meta2)]
    for name in sorted(set(tables1) & set(tables2)):
        a, b = tables1[name], tables2[name]
        counts = diff_counts(a, b, name)
        if mode == "positional":
            if counts.isEmpty():
                parts.append(diff_rows(a, b, name, keys.get(name, ()), mode))
            else:
                parts.append(counts)
        else:
            parts += [counts, diff_rows(a, b, name, keys.get(name, ()), mode)]
    return reduce(DataFrame.unionByName, parts)


def diff_summary(report: DataFrame) -> DataFrame:
    """(metric, count) with all four metrics, zeros kept."""
    issue = F.col("issue")
    metric = (
        F.when(issue.isin("Missing in db1", "Missing in db2"), METRICS[0])
        .when(issue.startswith("Column missing"), METRICS[1])
        .when(issue == "Column changed", METRICS[2])
        .otherwise(METRICS[3])
    )
    counts = report.groupBy(metric.alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    names = report.sparkSession.createDataFrame([(i, m) for i, m in enumerate(METRICS)], "ord int, metric string")
    return names.join(counts, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("count"))
