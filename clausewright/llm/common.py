"""Shared pieces of the training-data operators: table access, Arrow batch helpers, reliable cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer single text is a step of its own.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text alone (plus `extra`), so that other columns, whatever their names, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or setCheckpointDir name it. Only a session in one
    JVM, where every folder is shared, gets one of its own when none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="clausewright-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of at most `limit` text bytes each (a row is never divided)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def joined_bytes(column: pa.Array, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one uint8 array, each followed by `gap` bytes of 0xFF (never part of UTF-8); starts and lengths."""
    parts = text_bytes(column)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    pad = b"\xff" * gap
    data = np.frombuffer(pad.join(parts) + pad, dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + gap))) if len(parts) else np.zeros(0, np.int64)
    return data, starts, lengths


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes of any byte range of one array, modulo 2**64, by prefix sums."""

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15 | 1):
        n = len(data)
        self.powers, self.inverses = _powers(n + 1, base)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _CACHE.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        kept = (both[0], both[1])
        if size <= 8_000_000:
            _CACHE[base] = kept
    return kept[0][:n], kept[1][:n]


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and start, with those that meet or overlap joined."""
    if not len(doc):
        return doc, low, high
    # Documents are put one after another, so that one running maximum serves all.
    number = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    shift = number * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    fresh = np.concatenate(([True], low[1:] + shift[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
    return doc[fresh], low[fresh], (reach - shift)[last]


#: Releases the exchanges of a query when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for results that are large and read more than once. The exchanges
    that made it are released as soon as it stands."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that have been read for the last time, on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): doc orders the documents and tells them apart. It is doc_id itself unless that is null or
    repeated somewhere; then it grows with (doc_id, digest of the text), nulls first, by a distributed sort.
    Rows that repeat both are one document."""
    own = texts(docs)
    if not own.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count():
        return own.select("doc_id", F.col("doc_id").alias("doc"), "text").filter("doc IS NOT NULL")
    keyed = own.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"), F.coalesce("text", F.lit("")).alias("text"))
    # A table, as the numbers of a sort can differ from one run of it to the next.
    order = keyed.select("doc_id", "_digest").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "_digest")
    ranks = written(order.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_of"), F.monotonically_increasing_id().alias("doc")), "order")
    return keyed.join(ranks, keyed["doc_id"].eqNullSafe(ranks["_id"]) & (keyed["_digest"] == ranks["_of"])).select("doc_id", "doc", "text").filter("doc IS NOT NULL")
