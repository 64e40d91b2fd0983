"""Session helpers: a tuned builder for local runs, lineage cuts, and input spreading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "qaforge", **conf: str) -> SparkSession:
    """Session for tests and benchmarks. On a cluster the caller's own session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Directory for lineage cuts: the session's own one; a scratch folder only in local mode."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        known = tempfile.mkdtemp(prefix="qaforge-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint, so a lost executor costs a re-read and not the whole history of a loop."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a source that arrives in fewer splits than there are cores.

    A no-op for inputs that already have enough splits, as any large table has.
    """
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
