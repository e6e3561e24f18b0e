"""Labelled rows for fitting, bounded: the only sampled input of any operator here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks that share the sample, which a limit leaves in one.
PARTS = 12


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, where: F.Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, the first by a digest of doc_id, so that reruns agree.
    Null ids and labels are left out; an id labelled twice counts with its larger label, an id with several texts with
    each of them, as far as the bound allows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    if where is not None:
        known = known.filter(where)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers: the bound that makes this broadcast safe.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(chosen), "doc_id")
    # An id may stand for many rows: the bound holds for rows too, the first by digests of id and text.
    few = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(rows)
    return few.repartition(PARTS)
