"""Incremental forms: pages to pairs, log upserts and prompt labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from qaforge.functions import labels as L
from qaforge.operators import extract as X
from qaforge.operators.dom import page_dom
from qaforge.operators.logs import upsert_log


def first_arrivals(stream: DataFrame, key: str = "url", arrived: str | None = None, remember: str = "30 days") -> DataFrame:
    """Rows whose key has not arrived within the given time before.

    The state holds a key until the watermark has passed its first arrival by `remember`, so it grows with the keys of that time and not with all
    keys ever. `arrived` names the column with the time of arrival; without one it is the time of the batch. A table that is no stream is
    taken as one arrival.
    """
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    timed = stream if arrived else stream.withColumn("_arrived", F.current_timestamp())
    return timed.withWatermark(arrived or "_arrived", remember).dropDuplicatesWithinWatermark([key]).select(*stream.columns)


def pages_to_qa(
    stream: DataFrame, mode: str = "union", rules: Sequence[str] = tuple(X.SITE_RULES), arrived: str | None = None, remember: str = "30 days"
) -> DataFrame:
    """Pairs of each address, the first time it arrives within the time that is remembered (see first_arrivals)."""
    return X.extract_qa(page_dom(first_arrivals(stream, "url", arrived, remember)), mode, rules)


def stream_pages_to_qa(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    return (
        pages_to_qa(stream, **options)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


BUCKET = "log_bucket"


def stream_log_upsert(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep `table`, partitioned by a hash bucket of the key, at one row per (prompt, response) while turns arrive.

    A batch reads the buckets that its keys fall into and overwrites those partitions alone. A batch that is run again after a failure finds its own
    rows there and picks the same ones, so nothing counts twice.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in ("user_prompt", "response")])
        new = batch.withColumn(BUCKET, F.pmod(key, F.lit(buckets)).cast("int"))
        touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]  # a row per bucket
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(BUCKET).parquet(table)
        old = spark.read.schema(schema).parquet(table).filter(F.col(BUCKET).isin(touched))
        merged = upsert_log(old, new).repartition(BUCKET)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_log(spark: SparkSession, table: str) -> DataFrame | None:
    """The upserted log; None before the first batch."""
    try:
        return spark.read.parquet(table).drop(BUCKET)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def label_prompts(stream: DataFrame, text: str = "text") -> DataFrame:
    """Add intent, platform, touchpoint, style, energy and complexity to each prompt; no state."""
    t = F.col(text)
    e = L.energy(t)
    return stream.withColumns(
        {
            "intent": L.intent6(t),
            "platform": L.guess_platform(t),
            "touchpoint": L.guess_touchpoint(t),
            "prompt_style": L.prompt_style(t),
            "energy_level": e["level"],
            "energy_score": e["score"],
            "complexity": L.complexity(t),
        }
    )


def stream_label(stream: DataFrame, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    return (
        label_prompts(stream, text)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
