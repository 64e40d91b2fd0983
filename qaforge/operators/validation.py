"""Checks and profiles of training files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaforge.functions.common import let, strip
from qaforge.sources.readers import list_files, read_lines

ROLES = ("system", "user", "assistant")


def _messages(line: Column) -> Column:
    """Messages as JSON texts, null unless the record has a list of them."""
    raw = F.get_json_object(line, "$.messages")
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>"))


def _is_object(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull() & strip(line).startswith("{")


def validate_strict(lines: DataFrame, file: str = "file", line: str = "line", text: str = "value") -> DataFrame:
    """(file, line, msg_no, error): every fault of every record; a file without records has one fault at line 0."""

    def fault(m: Column) -> Column:
        role, content = F.get_json_object(m, "$.role"), F.get_json_object(m, "$.content")
        is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(m), "$.content", "variant")) == "STRING"
        return (
            F.when(~_is_object(m), "message must be an object")
            .when(role.isNull() | ~role.isin(*ROLES), "invalid or missing role")
            .when(~F.coalesce(is_text, F.lit(False)) | (strip(content) == ""), "content must be a non-empty string")
        )

    own = (
        F.when(F.try_parse_json(F.col("_v")).isNull(), "invalid JSON")
        .when(~strip(F.col("_v")).startswith("{"), "JSON object expected")
        .when(F.coalesce(F.size("_m"), F.lit(0)) < 2, "messages must be a list of at least two")
    )
    per_message = F.filter(
        F.transform("_m", lambda m, i: F.struct((i + 1).alias("msg_no"), fault(m).alias("error"))),
        lambda e: e["error"].isNotNull(),
    )
    filled = (
        lines.select(file, line, strip(F.col(text)).alias("_v"))
        .filter("_v <> ''")
        .withColumn("_m", F.when(_is_object(F.col("_v")), _messages(F.col("_v"))))
        .withColumn("_own", own)
    )
    errors = F.when(
        F.col("_own").isNotNull(), F.array(F.struct(F.lit(0).alias("msg_no"), F.col("_own").alias("error")))
    ).otherwise(per_message)
    found = filled.select(file, line, F.explode(errors).alias("e")).select(file, line, "e.msg_no", "e.error")
    empty = (
        lines.groupBy(file)
        .agg(F.max((strip(F.col(text)) != "").cast("int")).alias("_any"))
        .filter("_any = 0")
        .select(file, F.lit(0).cast(lines.schema[line].dataType).alias(line), F.lit(0).alias("msg_no"), F.lit("file is empty").alias("error"))
    )
    return found.unionByName(empty)


def roles_complete(messages: Column) -> Column:
    """System, user and assistant all occur."""
    return F.forall(F.array(*[F.lit(r) for r in ROLES]), lambda r: F.array_contains(messages["role"], r))


def validate_roles(lines: DataFrame, text: str = "value", out: str = "ok") -> DataFrame:
    """Flag lines that are JSON objects whose messages hold all three roles."""
    roles = F.transform(_messages(F.col(text)), lambda m: F.get_json_object(m, "$.role"))
    ok = let(roles, lambda rs: F.forall(F.array(*[F.lit(r) for r in ROLES]), lambda r: F.array_contains(rs, r)))
    return lines.withColumn(out, F.coalesce(_is_object(F.col(text)) & ok, F.lit(False)))


def exact_roles(messages: Column) -> Column:
    """Exactly system, user, assistant, in this order."""
    return F.coalesce(messages["role"] == F.array(*[F.lit(r) for r in ROLES]), F.lit(False))


def validate_exact_roles(records: DataFrame, messages: str = "messages", out: str = "ok") -> DataFrame:
    return records.withColumn(out, exact_roles(F.col(messages)))


def file_verdict(files: DataFrame, errors: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, ok, first_error): a file is good if it has no fault, else its first one is named."""
    first = errors.groupBy(file).agg(F.min_by("error", F.struct(line, "msg_no")).alias("first_error"))
    return files.select(file).distinct().join(first, file, "left").select(
        file, F.col("first_error").isNull().alias("ok"), "first_error"
    )


def validate_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(faults with file and line, verdict per file) of stored training files, read in splits; a file of no bytes is empty too."""
    lines, files = read_lines(spark, path), list_files(spark, path)
    filled = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    blank = files.join(filled, "file", "left_anti").select("file", F.lit(0).cast("long").alias("line"), F.lit(0).alias("msg_no"), F.lit("file is empty").alias("error"))
    errors = validate_strict(lines).unionByName(blank)
    return errors, file_verdict(files, errors)


def total_length(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda s, m: s + F.coalesce(F.length(m["content"]), F.lit(0)))


def length_warnings(records: DataFrame, limit: int = 5000, messages: str = "messages") -> DataFrame:
    """Records whose contents together are longer than the limit."""
    return records.withColumn("total_length", total_length(F.col(messages))).filter(F.col("total_length") > limit)


# Fixed values: (fewer rows than, epochs, batch size, learning rate multiplier); the last row has no limit.
TIERS = [(50, 10, 1, 0.3), (300, 6, 2, 0.25), (1000, 5, 4, 0.2), (None, 3, 8, 0.15)]


def size_tier(records: DataFrame, file: str = "file") -> DataFrame:
    """(file, n_rows, n_epochs, batch_size, lr_multiplier) by the number of rows."""
    n = F.col("n_rows")

    def value(i: int) -> Column:
        out = F
        for row in TIERS[:-1]:
            out = out.when(n < row[0], F.lit(row[i]))
        return out.otherwise(F.lit(TIERS[-1][i]))

    return records.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows")).select(
        file, "n_rows", value(1).alias("n_epochs"), value(2).alias("batch_size"), value(3).alias("lr_multiplier")
    )
