"""Operator 10, mixing sources to target weights: systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.common import cut, text_bytes

#: Weights of the sources in order of code points, repeated (fixed values of the contract).
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Mean rows of one bucket of a source; buckets divide the prefix sum of a hot source among tasks.
BUCKET_ROWS = 4096
SEED = 42


#: Columns that mix adds; columns of the documents that are named so give way.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def own_prefix(names: list[str]) -> str:
    """A prefix for columns of the operator's own that no name begins with."""
    prefix = "_mix_"
    while any(n.lower().startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix


def sized(docs: DataFrame, keep_text: bool, prefix: str) -> DataFrame:
    """docs with PREFIXsize (words: runs of anything but ASCII white space; null: 0) and PREFIXtie (the text's digest).
    Splitting the bytes in Arrow batches costs a tenth of a regular expression over the characters."""
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    added = [prefix + "size", prefix + "tie"]
    schema = T.StructType([*kept, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.StringType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = text_bytes(batch.column(batch.schema.get_field_index("text")))
            size = pa.array([len(x.split()) for x in data], pa.int64())
            tie = pa.array([hashlib.md5(x).hexdigest() for x in data], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), size, tie], [*(f.name for f in kept), *added])

    return docs.mapInArrow(count, schema)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, size) to one row per source: source, source_size, n_docs, target, rate (expected copies).

    A source's target is its weight's share of all words, but at most `most` times its size; what is cut off goes to the
    others by weight until none is above. That fixed point is a water level: with sources by rising size per weight,
    those whose limit lies under the level of the rest are full. One row per source takes part, and one task sorts them:
    sources are names of collections, thousands at most, not addresses of documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = totals.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    rising = Window.partitionBy(F.lit(1)).orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(rising), F.lit(0.0))
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    level = (total - before("limit")) / (F.sum("weight").over(everything) - before("weight"))
    leveled = weighed.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # The level of the first source that isn't full holds for all that aren't.
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(rest * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "source_size", "n_docs", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def _digits(column: F.Column) -> F.Column:
    """A number below 2**28 from the md5 of a text: the same on any engine."""
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies, all rows and columns kept.

    Within a source, documents stand in order of (bucket, size, doc_id, digest of the text); each is expected `rate`
    times, and gets one copy for every integer that the running sum of rates, begun at the source's random offset,
    crosses. Within a bucket that order spreads the copies over all sizes, so the words taken come near the target.
    Buckets are dealt by a digest of doc_id and text and their number follows the source's rows, so no task gathers a
    source, nor the rows of one id.
    Null sources are one source, the last; null texts have size 0; a source without words has target 0 and no copies;
    rows alike in all columns are told apart by nothing, and any of them may get the copy. Reruns agree. Columns of docs
    may have any names; those named like an added one give way to it."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    prefix, rows = own_prefix(kept), docs.select(*kept)
    return _deal(sized(rows, True, prefix), sized(docs.select("doc_id", "source", "text"), False, prefix), kept, prefix, weights, most, seed)


def _deal(rows: DataFrame, sizes: DataFrame, kept: list[str], prefix: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """rows and sizes: as made by sized() with this prefix, the second with doc_id and source at least."""
    fresh = lambda name: prefix + name
    size, bucket, label = map(fresh, ("size", "bucket", "label"))
    source = F.col("source").cast("string")
    targets = source_targets(sizes.select(source.alias("source"), F.col(size).alias("size")), weights, most)
    targets = cut(targets.select(*(F.col(c).alias(fresh(c)) for c in targets.columns)))  # a row per source, read twice
    place_in = lambda df: (
        df.join(targets, source.eqNullSafe(F.col(fresh("source"))))
        .withColumn(label, F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")))
        .withColumn(bucket, _digits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), fresh("tie"))) % F.ceil(F.col(fresh("n_docs")) / BUCKET_ROWS))
    )
    # Rows before each bucket of a source: from counts of the buckets alone.
    counts = place_in(sizes.select("doc_id", "source", fresh("tie"))).groupBy(label, bucket).agg(F.count(F.lit(1)).alias(fresh("rows")))
    earlier = Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(label).alias(fresh("l")), F.col(bucket).alias(fresh("b")), F.coalesce(F.sum(fresh("rows")).over(earlier), F.lit(0)).alias(fresh("before")))
    within = Window.partitionBy(label, bucket).orderBy(size, F.col("doc_id").asc_nulls_first(), fresh("tie"))
    ranked = place_in(rows).withColumn(fresh("rank"), F.row_number().over(within)).join(starts, (F.col(label) == F.col(fresh("l"))) & (F.col(bucket) == F.col(fresh("b"))))
    place = F.col(fresh("before")) + F.col(fresh("rank"))
    offset = _digits(F.concat(F.lit(f"{seed}:"), F.col(label))) / F.lit(float(1 << 28))
    crossed = F.floor(F.col(fresh("rate")) * place + offset) - F.floor(F.col(fresh("rate")) * (place - 1) + offset)
    return ranked.select(*kept, F.col(size).alias("mix_size"), F.col(fresh("source_size")).alias("mix_source_size"), F.col(fresh("target")).alias("mix_target"), F.least(crossed, F.lit(most)).cast("long").alias("mix_copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of mix."""
    prefix = own_prefix([])
    rows = cut(sized(docs.select("doc_id", "text", "source"), False, prefix))  # a few numbers a document, read three times
    mixed = _deal(rows, rows, ["doc_id"], prefix, WEIGHTS, MOST_COPIES, SEED)
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document once per copy, with copy_no from 0. Columns of docs named like copy_no or like
    what mix adds give way."""
    mixed = mix(docs).filter("mix_copies > 0")
    return mixed.select(*(c for c in docs.columns if c.lower() not in (*ADDED, "copy_no")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)).alias("copy_no"))


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, (source_size * {MOST_COPIES})::DOUBLE AS cap FROM totals
), summed AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER rising, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0.0)) AS level
  FROM weighed WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rest AS (
  SELECT arg_min(level, cap / weight) AS level FROM summed WHERE NOT cap <= level * weight
), targets AS (
  SELECT source, source_size, n_docs, CASE WHEN cap <= s.level * weight THEN cap ELSE r.level * weight END AS target FROM summed s CROSS JOIN rest r
), dealt AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
    coalesce('s:' || d.source, 'null') AS label,
    ('0x' || left(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', tie)), 7))::BIGINT % ceil(t.n_docs / {BUCKET_ROWS}.0)::BIGINT AS bucket
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY bucket, size, doc_id NULLS FIRST, tie) AS place,
    ('0x' || left(md5('{SEED}:' || label), 7))::BIGINT / {1 << 28}.0::DOUBLE AS start FROM dealt
)
SELECT doc_id, size, source_size, target, size * least(floor(rate * place + start) - floor(rate * (place - 1) + start), {MOST_COPIES})::BIGINT AS taken FROM placed
"""
