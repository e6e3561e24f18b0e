"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, and the mixture, one after another.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's result to
the shared folder in spark.checkpoint.dir and reads it again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm.common import removed, shared_folder, table
from clausewright.llm.decontaminate import drop_contaminated
from clausewright.llm.mixing import mixed_documents
from clausewright.llm.rules import keep_quality
from clausewright.llm.secrets import redact_secrets
from clausewright.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, with copy_no."""
    return mixed_documents(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", leaks), ("secret_scans", secrets), ("source_mixing", mixture)]

#: A trained classifier and fingerprint components are beyond SQL; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            removed(spark, last)
        last = docs
    return docs
