"""Operator 4, quality classifier: votes of labelled latent-semantic vectors, by exact blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import steps, texts
from clausewright.llm.features import Features
from clausewright.llm.labelled import labelled_sample

#: Bounds of the fit: labelled rows broadcast, bits of a hashed term in each of the two families, latent dimensions.
SAMPLE_ROWS, BITS, DIMENSIONS = 2500, 11, 48
NEIGHBOURS = 15
RETURN_WEIGHT = 1.0
#: Rows of one block of products.
BLOCK = 256
HELD_OUT = 1


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def term_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed character trigrams, of word pairs, and of returning words by distance; a dense row per text."""
    f = Features(column, BITS)
    out = []
    for (numbers, doc), bits in ((f.chars(3), BITS), (f.word_pairs(), BITS), (f.returns(), 6)):
        out.append(np.bincount((doc << bits) + numbers, minlength=f.n << bits).reshape(f.n, 1 << bits))
    return np.hstack(out).astype(np.float32)


def damped(counts: np.ndarray) -> np.ndarray:
    """Logarithms of terms. Words that return are weighed against all words, as two texts that repeat themselves need
    not share a trigram: RETURN_WEIGHT times the root of their share, near ones more than far ones."""
    terms, back = counts[:, :-64], counts[:, -64:]
    share = back / np.maximum(terms[:, 1 << BITS :].sum(axis=1, keepdims=True) + 1, 1)
    return np.hstack([unit(np.log1p(terms)), RETURN_WEIGHT * np.sqrt(share)])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Space:
    """Weights of the terms, their latent directions, and the labelled vectors."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(damped(counts) * self.idf) @ self.directions)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the NEIGHBOURS most similar labelled vectors, each weighed by the fourth power of its
        similarity; the prior where nothing is similar. Ties at the last place go to the earlier vectors of the sample,
        which is in order of content."""
        scores = np.empty(len(vectors))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(vectors), BLOCK):
            similar = vectors[at : at + BLOCK] @ self.vectors.T
            least = -np.partition(-similar, k - 1, axis=1)[:, k - 1 : k]
            above, level = similar > least, similar == least
            near = above | level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))
            weight = np.where(near, np.maximum(similar, 0.0).astype(np.float64) ** 4, 0.0)
            total = weight.sum(axis=1)
            scores[at : at + BLOCK] = np.where(total > 1e-9, weight @ self.labels / np.maximum(total, 1e-9), self.prior)
        return scores


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Space | None:
    """From at most `rows` labelled rows outside the held-out fold. None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            packed = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in term_counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(packed, pa.binary())], ["label", "counts"])

    sample = labelled_sample(docs, labels, "quality", rows, fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "text", "label")
    found = sample.mapInArrow(count, "label int, counts binary").collect()
    found.sort(key=lambda r: (r["counts"], r["label"]))
    if not found:
        return None
    counts = np.array([np.frombuffer(r["counts"], dtype=np.uint16) for r in found], dtype=np.float32)
    y = np.array([r["label"] > 0 for r in found], dtype=np.float64)
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    idf[-64:] = 1
    weighted = unit(damped(counts) * idf)
    directions = leading(weighted, min(DIMENSIONS, *weighted.shape))
    return Space(idf, directions, unit(weighted @ directions), y, float(y.mean()))


def leading(matrix: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((matrix.shape[1], min(k + 8, *matrix.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, rotation = np.linalg.svd(matrix @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ rotation.T)[:, :k], dtype=np.float32)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. The score of a text is a function of the text alone.

    Fitted on labelled rows of the two other folds; what is broadcast is bounded by SAMPLE_ROWS. A text without terms
    (null, empty, one letter) gets the share of label 1 among the labelled rows; without labelled rows every score is
    0.5. A null doc_id isn't held out; an empty table gives no rows; repeated rows repeat; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in steps(batches, limit=1_000_000):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                scores = space.vote(space.project(term_counts(part.column(1)))) if space else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(scores, 0.0, 1.0))], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
