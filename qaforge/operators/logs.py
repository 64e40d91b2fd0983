"""Chat log cleaning and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions.common import strip
from qaforge.operators.dedupe import digest, first_per_key
from qaforge.rules import lexicons as R


def clean_chat_log(
    log: DataFrame, fields: Sequence[str] = ("user_prompt", "response"), banned_response: str = R.BANNED_RESPONSE,
    pos: str = "pos", corrupt: str | None = None,
) -> DataFrame:
    """First row per trimmed fields (null counts as blank), without unreadable lines and banned responses."""
    rows = log.filter(F.col(corrupt).isNull()) if corrupt else log
    rows = rows.filter(strip(F.coalesce(F.col("response"), F.lit(""))) != banned_response)
    return first_per_key(rows, [strip(F.coalesce(F.col(f), F.lit(""))) for f in fields], [F.col(pos)])


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def upsert_log(
    log: DataFrame, new: DataFrame | None = None, seq: str = "seq", keys: Sequence[str] = ("user_prompt", "response"),
    rating: str = "rating", rating_msg: str = "rating_msg",
) -> DataFrame:
    """One row per key: the last one with a rating or a rating message, else the first."""
    rows = log if new is None else log.unionByName(new)
    rated = _filled(F.col(rating)) | _filled(F.col(rating_msg))
    order = F.struct(
        rated.cast("int").alias("r"), F.when(rated, F.col(seq)).otherwise(-F.col(seq)).alias("s")
    )
    row = F.struct(*[F.col(c) for c in rows.columns])
    key = digest([F.coalesce(F.col(k), F.lit("")) for k in keys])
    return rows.groupBy(key.alias("_k")).agg(F.max_by(row, order).alias("_r")).select("_r.*")
