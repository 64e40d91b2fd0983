"""Writers for pair files, chat records, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaforge.functions.common import fill
from qaforge.operators.prompts import to_chat_records


def write_qa(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One pair object per line; other alphabets are written as they are."""
    df.select("question", "answer").write.mode(mode).json(path)


def write_chat(df: DataFrame, path: str, system: Column | str | None = None, mode: str = "overwrite") -> None:
    """Chat records of the pairs with two non-blank sides, with a system text or without."""
    to_chat_records(df, system).select("messages").write.mode(mode).json(path)


def prompt_completion(df: DataFrame, system: Column, q: str = "question", a: str = "answer") -> DataFrame:
    """(prompt, completion) in the older training shape; the completion starts with a space."""
    return df.select(
        fill("{s}\nQ: {q}\nA:", s=system, q=F.col(q)).alias("prompt"),
        F.concat(F.lit(" "), F.col(a)).alias("completion"),
    )


def write_prompt_completion(df: DataFrame, path: str, system: Column, mode: str = "overwrite") -> None:
    prompt_completion(df, system).write.mode(mode).json(path)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite", max_rows: int = 5_000_000) -> None:
    """One folder per context or site. A large one is written by every task that holds rows of it, in many files."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).partitionBy(by).json(path)


def grouped_by_url(
    df: DataFrame, url: str = "url", pos: str = "pos", q: str = "question", a: str = "answer", per_row: int | None = None
) -> DataFrame:
    """(url, faqs): the pairs of an address in order, one row per address; a row has to fit into a task's memory.

    Files of addresses of any size are written by write_grouped_by_url. With `per_row`, an address with more places fills several rows, counted by a further column `part`.
    """
    part = F.lit(0) if per_row is None else F.floor(F.col(pos) / per_row).cast("int")
    item = F.struct(F.col(pos).alias("pos"), F.col(q).alias("Q"), F.col(a).alias("A"))
    grouped = df.groupBy(url, part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("f"))
    return grouped.select(
        url, *([] if per_row is None else ["part"]), F.transform("f", lambda x: F.struct(x["Q"].alias("Q"), x["A"].alias("A"))).alias("faqs")
    )


def write_grouped_by_url(
    df: DataFrame, path: str, mode: str = "overwrite", url: str = "url", pos: str = "pos", q: str = "question", a: str = "answer"
) -> None:
    """One JSON line per address with all its pairs in order, whatever their number.

    A line is written pair by pair and never held as one value: rows are dealt by address and sorted, the first of an address opens its line and the last one closes
    it. Between the pairs of a line stands a blank, which JSON allows. An address is written by one task, as its line lies in one file.
    """
    order = Window.partitionBy(url).orderBy(F.col(pos).asc_nulls_first(), F.col(q), F.col(a))
    rows = df.select(
        F.row_number().over(order).alias("_no"), F.lead(F.lit(1)).over(order).isNull().alias("_last"),
        F.to_json(F.struct(F.col(url).alias("url"))).alias("_u"), F.to_json(F.struct(F.col(q).alias("Q"), F.col(a).alias("A"))).alias("_pair"))
    head = F.when(F.col("_u") == "{}", F.lit("{")).otherwise(F.concat(F.col("_u").substr(F.lit(1), F.length("_u") - 1), F.lit(",")))
    text = F.concat(
        F.when(F.col("_no") == 1, F.concat(head, F.lit('"faqs":['))).otherwise(F.lit(",")), F.col("_pair"), F.when(F.col("_last"), F.lit("]}\n")).otherwise(F.lit("")))
    rows.select(text.alias("value")).write.mode(mode).option("lineSep", " ").text(path)


def write_report_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and every field in quotes; missing values are written as empty text."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_url_lists(visited: DataFrame, failed: DataFrame, visited_path: str, failed_path: str) -> None:
    """Distinct visited addresses and, apart from them, the failed ones."""
    visited.select("url").distinct().write.mode("overwrite").text(visited_path)
    failed.select("url").distinct().write.mode("overwrite").text(failed_path)


def append_log(df: DataFrame, path: str) -> None:
    """Add one JSON object per turn to a log folder."""
    df.write.mode("append").json(path)


