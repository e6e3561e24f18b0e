"""Operator 11, document fingerprints: a digest of the quartiles of hashed byte triplets and of the length, and a bounded
score of how alike two digests are."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import STEP_BYTES, steps, text_bytes, texts

BUCKETS, WINDOW = 256, 5
#: The triplets of a window of five bytes that hold its last byte, as places in the window: each is counted once.
TRIPLETS = ((4, 3, 2), (4, 3, 1), (4, 3, 0), (4, 2, 1), (4, 2, 0), (4, 1, 0))
#: Odd factor that spreads a triplet over 32 bits (golden ratio).
SPREAD = np.uint32(0x9E3779B1)
#: Steps of the length's code for each doubling, and what a step of difference counts.
LENGTH_STEPS, LENGTH_WEIGHT = 8, 3
#: What two codes of a bucket count that are 0, 1, 2 or 3 quartiles apart.
PENALTY = np.array([0, 1, 2, 6])
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def bucket_counts(text: bytes) -> np.ndarray:
    """How many triplets each bucket has. Four zero bytes go first, so that every byte ends a window."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    data = np.frombuffer(bytes(WINDOW - 1) + text, dtype=np.uint8)
    for at in range(0, len(text), BLOCK):
        part = data[at : at + BLOCK + WINDOW - 1].astype(np.uint32)
        n = len(part) - WINDOW + 1
        for kind, (i, j, k) in enumerate(TRIPLETS):
            whole = part[i : i + n] | part[j : j + n] << np.uint32(8) | part[k : k + n] << np.uint32(16) | np.uint32(kind << 24)
            counts += np.bincount(whole * SPREAD >> np.uint32(24), minlength=BUCKETS)
    return counts


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many of the three quartiles of all counts it exceeds."""
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    return (counts[:, None] > np.partition(counts, at)[at]).sum(axis=1)


def fingerprint(text: bytes) -> str:
    """One byte for the length's logarithm and two bits a bucket, as lowercase hexadecimal digits. Equal texts have equal
    fingerprints; the empty text has zeros alone."""
    length = min(255, int(np.log2(len(text) + 1) * LENGTH_STEPS))
    codes = quartile_codes(bucket_counts(text)).astype(np.uint8).reshape(-1, 4)
    return bytes([length]).hex() + (codes << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes().hex()


def decoded(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and codes as a row for each fingerprint."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(-1, 1 + BUCKETS // 4)
    return raw[:, 0].astype(np.int64), (raw[:, 1:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3).reshape(len(raw), BUCKETS)


def likeness_of(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of pairs, 0 to 1: one less the difference of codes and lengths, over the difference that the same codes
    would have if they were dealt to the buckets at random. Equal fingerprints have 1; at chance or worse it is 0."""
    if not left:
        return np.zeros(0)
    (n, a), (m, b) = decoded(left), decoded(right)
    difference = PENALTY[np.abs(a.astype(np.int8) - b.astype(np.int8))].sum(axis=1) + LENGTH_WEIGHT * np.abs(n - m)
    shares = [np.stack([(codes == c).sum(axis=1) for c in range(4)], axis=1) for codes in (a, b)]
    chance = np.einsum("ri,ij,rj->r", shares[0], PENALTY[np.abs(np.arange(4)[:, None] - np.arange(4))], shares[1]) / BUCKETS
    return np.where(difference == 0, 1.0, np.clip(1 - difference / np.maximum(chance, 1e-9), 0.0, 1.0))


def likeness(left: Column, right: Column) -> Column:
    """likeness_of() for columns of fingerprints; null where either is null."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        out[known] = likeness_of(left[known].tolist(), right[known].tolist())
        return pd.Series(out).astype("Float64").mask(~known)

    return run(left, right)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and fingerprint of the whole text. Null texts are empty; texts of any
    length are counted in blocks; repeated rows repeat; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(map(fingerprint, data), pa.string())], names=["doc_id", "n_bytes", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, fingerprint string")


#: Place of a row in descending order of doc_id (nulls last), then of the text's hash; all three ascend.
ORDER = ("CAST(doc_id IS NULL AS int) AS k1", "coalesce(~doc_id, 0L) AS k2", "xxhash64(coalesce(text, '')) AS k3")


def first_keys(own: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """The first key of each of at most `parts` ranges of about as many rows: keys alone are dealt, and one for each
    range comes to the driver. Every range begins with a row that exists."""
    keys = own.selectExpr(*ORDER).repartitionByRange(parts, "k1", "k2", "k3")
    found = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("k1", "k2", "k3")).alias("k")).collect()
    return sorted(tuple(row["k"]) for row in found)


def points(text: bytes) -> np.ndarray:
    """Where code points begin."""
    return np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)


def first_points(text: bytes, n: int) -> bytes:
    """The first n code points; no more than they can take is looked at."""
    head = text[: 4 * n + 4]
    at = points(head)
    return head[: at[n]] if n < len(at) else text if len(head) == len(text) else head


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last third replaced by the first as many (or all) of the next."""
    at = points(text)
    n = len(at)
    k = n // 3
    return n, (text[: at[n - k]] if k else text) + first_points(following, k)


MOVED = "part int, last boolean, k1 int, k2 long, k3 long, doc_id long, n_bytes long, packed binary, fingerprint string"
_KINDS = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())


def in_order(docs: DataFrame) -> DataFrame:
    """Rows of MOVED, in ranges of descending doc_id (nulls last; rows that share an id by a hash of their texts), each
    range sorted within its partition. Ranges are found from keys alone; then each row moves once, compressed. The first
    row of a range goes to the range before it as well, marked as its last, so no range waits for another. The range of
    the lowest ids ends with the very first row."""
    spark, own = docs.sparkSession, texts(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = first_keys(own, parts)
    held, named = spark.sparkContext.broadcast(firsts), spark.sparkContext.broadcast({k: i for i, k in enumerate(firsts)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, numbers = held.value, named.value
        for batch in steps(batches):
            rows = []
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
            for doc, text, *key in zip(columns[0], text_bytes(batch.column(1)), *columns[1:]):
                key = tuple(key)
                row = (*key, doc, len(text), pa.compress(text, codec="zstd", asbytes=True), fingerprint(text))
                rows.append((max(0, bisect_right(starts, key) - 1), False, *row))
                if key in numbers:
                    rows.append(((numbers[key] - 1) % len(starts), True, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=[f.split()[0] for f in MOVED.split(", ")])

    dealt = own.selectExpr("doc_id", "text", *ORDER).mapInArrow(deal, MOVED).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("part", "last", "k1", "k2", "k3")


def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, fingerprint, text of the next, fingerprint of the next) from a partition of in_order()."""
    before, part, ended = None, None, False
    for batch in batches:
        for i in range(batch.num_rows):
            at, last, _, _, _, doc, n, packed, mark = (c[i].as_py() for c in batch.columns)
            if at != part:
                before, part, ended = None, at, False
            if ended:
                continue  # rows alike in id and text may begin a range together; the first of them is enough
            row = (doc, pa.decompress(packed, n, codec="zstd", asbytes=True) if n else b"", mark)
            if before is not None:
                yield (*before, *row[1:])
            before, ended = row, last


def grouped(rows: Iterator[tuple], limit: int = STEP_BYTES) -> Iterator[list[tuple]]:
    """Rows of followers() in lists of few bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit or len(held) >= 1000:
            yield held
            held, size = [], 0
    if held:
        yield held


def following_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) of every row of docs; the next is the one after it by
    descending doc_id, after the last the first. The only row follows itself; null texts are empty; repeated rows follow
    one another; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(followers(batches)):
            doc, text, mark, other, following = zip(*rows)
            as_text = lambda c: pa.array(c, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), as_text(text), pa.array(mark), as_text(other), pa.array(following)], names=["doc_id", "text", "fingerprint", "next_text", "next_fingerprint"])

    return in_order(docs).mapInArrow(run, "doc_id long, text string, fingerprint string, next_text string, next_fingerprint string")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each text's fingerprint beside those of its edited text and of the next document, as
    following_texts() orders them. Two empty texts are alike (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(followers(batches)):
            doc, text, own, other, following = map(list, zip(*rows))
            n, changed = zip(*map(edited, text, other))
            marks = [fingerprint(x) for x in changed]
            values = [pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]), pa.array(own), pa.array(marks), pa.array(likeness_of(own, marks)), pa.array(likeness_of(own, following))]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *values], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
