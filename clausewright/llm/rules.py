"""Operator 6, quality rules: word and line rules, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clausewright.llm.common import steps, text_bytes, texts
from clausewright.llm.features import Features
from clausewright.llm.labelled import labelled_sample

#: Rules (fixed values of the contract).
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Texts whose calibrated probability of quality is lower are rejected.
THRESHOLD = 0.5
#: Bounds of the fit: labelled rows read, and bits of a feature number in each of the three families.
SAMPLE_ROWS, BITS = 3000, 16
EPOCHS, L2, RATE = 60, 1e-3, 0.5


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside a window of `size` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    seen: dict[tuple, int] = {}
    twice: list[int] = []
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            twice += (first, i)
    covered, end = 0, 0
    for i in sorted(set(twice)):
        covered += i + size - max(i, end)
        end = i + size
    return covered


def rule_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    chars = len(data.translate(None, b" \t\n\x0b\x0c\r")) if data.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Model:
    """One weight per feature number and family; the margin is calibrated by slope and offset."""

    weights: tuple[np.ndarray, ...]
    bias: float
    slope: float
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))

    def margins(self, column: pa.Array) -> np.ndarray:
        """Each family gives the mean weight of its features, so long and short texts are alike."""
        f = Features(column, BITS)
        total = np.full(f.n, self.bias)
        for w, (numbers, doc) in zip(self.weights, families(f)):
            total += np.bincount(doc, w[numbers], minlength=f.n) / np.maximum(np.bincount(doc, minlength=f.n), 1)
        return total


def families(f: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    return [f.words(), f.word_pairs(), f.chars(4)]


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows: distinct feature numbers (family * 2**BITS + number) and their shares of the family."""
    for batch in steps(batches):
        f = Features(batch.column(1), BITS)
        keys, values = [[] for _ in range(f.n)], [[] for _ in range(f.n)]
        for k, (numbers, doc) in enumerate(families(f)):
            total = np.bincount(doc, minlength=f.n)
            pairs, counts = np.unique(doc << BITS | numbers, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(f.n + 1) << BITS)
            for i in range(f.n):
                own = slice(cuts[i], cuts[i + 1])
                keys[i].append((pairs[own] & ((1 << BITS) - 1)) + (k << BITS))
                values[i].append(counts[own] / max(total[i], 1))
        pack = lambda parts, kind: pa.array([np.concatenate(x).astype(kind).tobytes() for x in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(2), pack(keys, np.int32), pack(values, np.float32)], ["label", "keys", "values"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on at most `rows` labelled rows: four fifths for the weights, the rest for the calibration. None without
    rows of both labels; then the rules alone decide."""
    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", "text", "label")
    found = sample.mapInArrow(count_features, "label int, keys binary, values binary").collect()
    found.sort(key=lambda r: (r["keys"], r["label"]))
    y = np.array([r["label"] > 0 for r in found], dtype=np.float64)
    if len(found) < 20 or y.min() == y.max():
        return None
    keys = [np.frombuffer(r["keys"], dtype=np.int32) for r in found]
    values = [np.frombuffer(r["values"], dtype=np.float32) for r in found]
    held = np.random.default_rng(0).permutation(len(found)) % 5 == 0
    train = np.flatnonzero(~held)
    row = np.repeat(np.arange(len(train)), [len(keys[i]) for i in train])
    key, value = np.concatenate([keys[i] for i in train]), np.concatenate([values[i] for i in train]).astype(np.float64)
    weights, bias = descend(row, key, value, y[train], 3 << BITS)
    margins = np.array([weights[k] @ v for k, v in zip(keys, values)]) + bias
    fresh = held if 0 < y[held].mean() < 1 else np.ones(len(y), dtype=bool)
    slope, offset = calibrate(margins[fresh], y[fresh])
    return Model(tuple(weights.reshape(3, -1).astype(np.float32)), bias, slope, offset)


def descend(row: np.ndarray, key: np.ndarray, value: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic loss with an L2 penalty, by gradient steps scaled per weight (AdaGrad), all rows at once."""
    used, column = np.unique(key, return_inverse=True)
    weights, squares, bias, bias_squares = np.zeros(len(used)), np.full(len(used), 1e-12), 0.0, 1e-12
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[column], minlength=len(y)) + bias, -30, 30)))
        error = (p - y) / len(y)
        gradient = np.bincount(column, value * error[row], minlength=len(used)) + L2 * weights / len(y)
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
        bias_squares += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(bias_squares)
    full = np.zeros(n)
    full[used] = weights
    return full, float(bias)


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton steps."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    scale = max(margins.std(), 1e-9)
    beta = np.array([1 / scale, -margins.mean() / scale])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, x.T @ (p - target)), -5, 5)
    return float(beta[0]), float(beta[1])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(batch: pa.RecordBatch, column: int, model: Model | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Measures, probability of quality and base_failed of each row."""
    data = text_bytes(batch.column(column))
    measures = [np.array(x, dtype=np.int64) for x in zip(*map(rule_counts, data))]
    n_words, repeated = measures[0], measures[4]
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    p = model.probability(model.margins(batch.column(column))) if model else np.ones(len(data))
    return measures, p, failed


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and probability. kept: not base_failed, and the calibrated probability of quality reaches `threshold`.
    A null text has no words and fails; without labelled rows of both kinds the probability is 1; an empty table gives
    no rows; repeated rows repeat; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            measures, p, failed = judge(batch, 1, shared.value)
            arrays = [batch.column(0), *map(pa.array, measures), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *MEASURES, "base_failed", "kept", "probability"])

    longs = ", ".join(f"{m} long" for m in MEASURES)
    return texts(docs).mapInArrow(score, f"doc_id long, {longs}, base_failed boolean, kept boolean, probability double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that quality_rules rejects; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            _, p, failed = judge(batch, column, shared.value)
            yield batch.filter(pa.array(~failed & (p >= threshold)))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))
