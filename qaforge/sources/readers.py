"""Readers for pair files, chat records, URL lists, sitemaps and databases."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge import schemas as S
from qaforge.functions.common import strip
from qaforge.session import cut_lineage

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_qa(spark: SparkSession, path: str, bad: str = "drop", short: bool = False) -> DataFrame:
    """Pairs from JSON lines; missing sides become "". Bad lines are dropped, kept (with their text) or fail."""
    schema = S.QA_SHORT if short else S.QA
    options = {"mode": "FAILFAST" if bad == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # Read as text: a JSON scan refuses queries that need nothing but the corrupt record column.
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select(F.from_json("value", _with_corrupt(schema), options).alias("r")).select("r.*")
    q, a = schema.fieldNames()
    rows = parsed.select(
        F.coalesce(F.col(q), F.lit("")).alias("question"), F.coalesce(F.col(a), F.lit("")).alias("answer"), CORRUPT
    )
    if bad == "keep":
        return rows
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_chat(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """(question, answer) from the first two messages. With `compat` one bad line empties the whole result."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    messages = F.from_json("value", S.CHAT)["messages"]
    q, a = F.try_element_at(messages, F.lit(1))["content"], F.try_element_at(messages, F.lit(2))["content"]
    pairs = lines.select(q.alias("question"), a.alias("answer"))
    good = F.col("question").isNotNull() & F.col("answer").isNotNull()
    if not compat:
        return pairs.filter(good)
    faults = pairs.agg(F.count_if(~good).alias("_bad")).withColumn("_one", F.lit(1))
    return pairs.withColumn("_one", F.lit(1)).join(F.broadcast(faults), "_one").filter("_bad = 0").select("question", "answer")


def tabulate_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with all fields found in any line, texts of the lines that are no JSON)."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    valid = F.try_parse_json("value").isNotNull()
    # The field names are gathered as one merged schema, an aggregate whose size is that of the schema.
    schema = lines.filter(valid).agg(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0]
    bad = lines.filter(~valid).select(F.col("value").alias("line"))
    ddl = (schema or "VOID").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    if not ddl.startswith("STRUCT<"):
        ddl = "STRUCT<value: STRING>"
    rows = lines.filter(valid).select(F.from_json("value", ddl).alias("r")).select("r.*")
    return rows, bad


# Parts of files whose line counts are sent to the readers; of more parts the counts are joined by shuffle.
BLOCKS_SENT = 500_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files with its number from 1, however many splits a file has.

    Files are read in splits, and lines carry the split they come from. A first pass counts the lines of each split; sums over the splits before it
    shift the place that a line has in its own. Blank lines count. No file is ever in one row or sorted.
    """
    at = ["_file", "_start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy(*at).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut_lineage(blocks.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))))  # a row per split
    if shifts.count() <= BLOCKS_SENT:
        shifts = F.broadcast(shifts)
    place = F.col("_id") - F.col("_first")
    # Both passes read the same splits in the same order; a file that changed in between is told.
    sure = F.when((place >= 0) & (place < F.col("_n")), place + F.col("_shift") + 1).otherwise(F.raise_error(F.concat(F.lit("file changed while it was read: "), "_file")))
    return lines.join(shifts, at).select(F.col("_file").alias("file"), sure.cast("long").alias("line"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of all files, those of no bytes as well; the listing that a scan holds on the driver anyway."""
    # Lines name local files with one slash.
    names = [re.sub(r"^file:/+", "file:/", f) for f in spark.read.text(path).inputFiles()]
    return spark.createDataFrame([(f,) for f in names], "file string")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed address per line, without blank lines."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).filter("url <> ''")


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series) -> pd.Series:
    """Bytes to text, unpacked first where they start with the gzip mark."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        data = bytes(b)
        if data[:2] == b"\x1f\x8b":
            try:
                data = gzip.decompress(data)
            except (OSError, EOFError, zlib.error):  # cut off or damaged
                return None
        return data.decode("utf-8", errors="ignore")

    return content.map(one)


def _locs(body: Column, row: str) -> Column:
    """`loc` of every `row` element, namespaces ignored; null if the text is no XML."""
    parsed = F.from_xml(body, f"`{row}` array<struct<loc:string>>", {"mode": "PERMISSIVE"})
    return parsed[row]["loc"]


def read_sitemaps(source: DataFrame | str | list[str], spark: SparkSession | None = None) -> DataFrame:
    """(sitemap, kind, pos, loc) from `(sitemap, body)` rows or from files, packed or not.

    `kind` is `url` for pages and `sitemap` for entries of an index. Broken XML falls back to a plain tag pattern.
    """
    if isinstance(source, (str, list)):
        files = (spark or SparkSession.getActiveSession()).read.format("binaryFile").load(source)
        df = files.select(F.col("path").alias("sitemap"), _decode("content").alias("body"))
    else:
        df = source.select("sitemap", "body")
    # Only well-formed text names its parts; the fallback reads every address as a page, as a plain scan does.
    whole = F.from_xml("body", "_x string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_x"})["_x"]
    crude = F.regexp_extract_all("body", F.lit(r"(?i)<loc>(.*?)</loc>"), F.lit(1))
    tagged = df.withColumns(
        {"_broken": whole.isNotNull(), "_s": _locs(F.col("body"), "sitemap"), "_u": _locs(F.col("body"), "url")}
    )
    none = F.array().cast("array<string>")

    def as_rows(kind: str, locs: Column) -> Column:
        kept = F.filter(F.coalesce(locs, none), lambda x: x.isNotNull() & (strip(x) != ""))
        return F.transform(
            kept, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), strip(x).alias("loc"))
        )

    found = F.when(F.col("_broken"), as_rows("url", crude)).otherwise(
        F.concat(as_rows("sitemap", F.col("_s")), as_rows("url", F.col("_u")))
    )
    return tagged.select("sitemap", F.explode(found).alias("e")).select("sitemap", "e.*")


def _tagged(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(sitemap, kind, id, loc) of the elements with the tag, parsed one by one as the file is read."""
    # A file that stops the parser ends there; the plain pass then finds more in it.
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).schema("loc string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("sitemap"), F.lit(tag).alias("kind"), F.monotonically_increasing_id().alias("id"), strip(F.col("loc")).alias("loc"))


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(sitemap, kind, pos, loc) of stored sitemap files of any size, packed or not; no file is ever one value.

    Elements come one by one from the XML source by row tag. A second pass reads the files as text that ends at every `>`, in splits, and finds what stands before
    `</loc`. A file in which it finds more addresses than the parser did is broken: its addresses are taken from that pass, each as a page. Files in which
    neither finds any, such as packed ones whose names do not say so, are unpacked and read whole.
    """
    parsed = cut_lineage(_tagged(spark, path, "url").unionByName(_tagged(spark, path, "sitemap")).filter("loc <> ''"))
    pieces = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("sitemap"), F.monotonically_increasing_id().alias("id"), "value")
    plain = pieces.withColumn("loc", strip(F.regexp_extract("value", r"(?i)^([^<]*)</loc\s*$", 1))).filter("loc <> ''").select("sitemap", F.lit("url").alias("kind"), "id", "loc")
    counts = parsed.groupBy("sitemap").agg(F.count(F.lit(1)).alias("n")).join(plain.groupBy("sitemap").agg(F.count(F.lit(1)).alias("m")), "sitemap", "full_outer")
    files = cut_lineage(counts.select("sitemap", (F.coalesce("m", F.lit(0)) > F.coalesce("n", F.lit(0))).alias("broken")))  # a row per file
    good, bad = files.filter("not broken").select("sitemap"), files.filter("broken").select("sitemap")
    entries = parsed.join(good, "sitemap", "left_semi").unionByName(plain.join(bad, "sitemap", "left_semi"))
    place = F.row_number().over(Window.partitionBy("sitemap", "kind").orderBy("id")) - 1
    found = entries.select("sitemap", "kind", place.alias("pos"), "loc")
    silent = [r["file"] for r in list_files(spark, path).join(files, F.col("file") == F.col("sitemap"), "left_anti").collect()]
    if not silent:
        return found
    return found.unionByName(read_sitemaps(silent, spark))


def read_side(
    spark: SparkSession, source: str | Mapping[str, str], tables: Iterable[str], order_by: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """All rows of each table of one database.

    `source` is a folder of Parquet tables, `catalog:<database>`, or the options of a JDBC connection (the caller's,
    with `partitionColumn`, bounds and `numPartitions` for a parallel read of a large table).
    """
    order_by = order_by or {}

    def one(name: str) -> DataFrame:
        if isinstance(source, str) and source.startswith("catalog:"):
            df = spark.table(f"{source.removeprefix('catalog:')}.{name}")
        elif isinstance(source, str):
            df = spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")
        else:
            df = spark.read.format("jdbc").options(**source).option("dbtable", name).load()
        return df.orderBy(order_by[name]) if name in order_by else df

    return {name: one(name) for name in tables}
