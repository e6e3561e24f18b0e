"""Input tables, with timestamps as instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; TIMESTAMP_NTZ columns become TIMESTAMP, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
