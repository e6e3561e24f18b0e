"""Sinks: uploads, JSON reports, text reports, event logs, model reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import stored_name


def store_uploads(uploads: DataFrame, folder: str) -> DataFrame:
    """SK1: uploads (contract_id, name, content) kept as one Parquet row each under their safe name, and the registry rows
    (contract_id, filename, file_path, file_size_bytes). One table instead of a file per upload: any store, any executor."""
    rows = uploads.withColumn("file_path", stored_name(F.col("contract_id"), F.col("name")))
    rows.write.mode("append").parquet(folder)
    return rows.select("contract_id", F.col("name").alias("filename"), "file_path", F.octet_length("content").cast("long").alias("file_size_bytes"))


def delete_uploads(spark, folder: str, contract_ids: list[str], to: str) -> DataFrame:
    """SK2: the stored uploads without the named ones, written anew to `to`; ids that are not there do not matter."""
    kept = spark.read.parquet(folder).filter(~F.col("contract_id").isin(*contract_ids))
    kept.write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def write_json(reports: DataFrame, path: str) -> None:
    """SK3."""
    reports.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """SK4, SK5, SK7: one text column, a row per line or report."""
    lines.write.mode("append").text(path)


def log_stream(lines: DataFrame, path: str, checkpoint: str):
    """SK7 on a stream."""
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def save_model(model, metrics: DataFrame, path: str) -> None:
    """SK6: a fitted pipeline and its metrics."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
