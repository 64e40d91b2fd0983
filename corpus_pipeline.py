"""A training corpus from raw documents: quality, near copies, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as Parquet and
read again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from qaforge.llm import decontaminate as decon
from qaforge.llm import mixing, quality, simhash, tokens
from qaforge.llm.common import written
from qaforge.llm.queries import byte_bpe, read

# Rows that go to a Python worker at once. Texts of some kilobytes make the usual 10,000 tens of megabytes, on both sides of each worker.
BATCH_ROWS = 1500
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"

# SQL cannot express the classifier, the fingerprints or the token files; tests/llm compares the stages with plain loops.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    judged = decon.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return judged.filter("n_hit = 0").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to equal shares of the bytes; a document appears as often as drawn."""
    return mixing.replicate(docs, mixing.source_rates(docs), seed=10).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a digest of what they hold read back."""
    return tokens.tokenize_documents(docs, byte_bpe())


def _in_small_batches(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCHES, min(BATCH_ROWS, int(spark.conf.get(BATCHES))))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
STAGES = [(name, _in_small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
