"""Model inference by name, each model loaded once a worker, and a small sequence model whose weights are fitted here."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import classify
from clausewright.operators.learn import accept

#: Hashed transitions that a fitted model tells apart; bounds its weights: labels x BUCKETS numbers.
BUCKETS = 4096
#: Before the first word of a text.
START = "^"
#: Steps whose weights stand at once in a worker, and steps whose buckets it keeps.
MOST_STEPS, MOST_KNOWN = 20_000, 200_000

Forward = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A model by what inference needs: its labels, and load(), which runs in a worker and gives the forward pass from an
    array of texts to logits (texts x labels). prepare, if given, is what the model reads of a text, made by Spark."""

    labels: tuple[str, ...]
    load: Callable[[], Forward]
    prepare: Callable[[Column], Column] | None = None


class Registry:
    """2.12c: models by name. A name that stands already is an error, unless replace says that a new version is meant."""

    def __init__(self) -> None:
        self._models: dict[str, Model] = {}

    def register(self, name: str, model: Model, replace: bool = False) -> None:
        if name in self._models and not replace:
            raise ValueError(f"model {name!r} is registered already")
        if not model.labels:
            raise ValueError(f"model {name!r} has no labels")
        self._models[name] = model

    def names(self) -> list[str]:
        return sorted(self._models)

    def get(self, name: str) -> Model:
        if name not in self._models:
            raise KeyError(f"no model {name!r}; registered: {', '.join(self.names()) or 'none'}")
        return self._models[name]

    def predict(self, rows: DataFrame, name: str, least: float | None = None, batch: int = 256) -> DataFrame:
        """Rows (with text) and ml_label, ml_confidence by the named model; under `least` the label is other. A null
        text is an empty one. Texts reach the model `batch` at a time; columns of these two names give way."""
        model = self.get(name)
        kept = [c for c in rows.columns if c not in ("ml_label", "ml_confidence")]
        text = F.coalesce("text", F.lit(""))
        scored = rows.withColumn("_m", _udf(model, batch)(model.prepare(text) if model.prepare else text))
        label = F.element_at(F.array(*map(F.lit, model.labels)), F.col("_m.label_id") + 1)
        score = F.col("_m.confidence")
        return scored.select(*kept, (label if least is None else accept(label, score, least)).alias("ml_label"), score.alias("ml_confidence"))


#: The registry of the library's callers.
MODELS = Registry()


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _udf(model: Model, batch: int):
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    load = model.load

    def make():
        forward = load()

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            p = softmax(np.asarray(forward(texts), dtype=np.float64))
            return {"label_id": p.argmax(axis=1).astype(np.int32), "confidence": np.round(p.max(axis=1), 4)}

        return predict

    fields = StructType([StructField("label_id", IntegerType()), StructField("confidence", DoubleType())])
    return predict_batch_udf(make, return_type=fields, batch_size=batch)


def steps_of(words: list[str], known: dict[tuple[str, str], int]) -> list[int]:
    """Buckets of the steps from each of a text's words, as lexical() leaves them, to the next, the first from START.
    known: buckets found before, kept by the caller and emptied when there are many."""
    if len(known) > MOST_KNOWN:
        known.clear()
    pairs = list(zip([START, *words], words))
    for pair in pairs:
        if pair not in known:
            known[pair] = int(hashlib.md5(" ".join(pair).encode()).hexdigest()[:7], 16) % BUCKETS
    return [known[pair] for pair in pairs]


def split_words(text: str | None) -> list[str]:
    return text.split(" ") if text else []


def counted(rows: DataFrame, label: str) -> DataFrame:
    """(label, bucket, n): how often each label's rows take the steps of each bucket; the rows themselves are bucket -1.
    Each task counts its own rows, a label in BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                own[-1] += 1
                np.add.at(own, steps_of(split_words(text), known), 1)
        for name, own in counts.items():
            (at,) = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(own[at])], ["label", "bucket", "n"])

    known = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), T.lexical(F.coalesce("text", F.lit(""))).alias("words"))
    return known.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit_chain(rows: DataFrame, label: str = "label") -> Model:
    """A sequence model of labelled rows (text, label): one chain of word transitions a label, counted over all rows and
    smoothed by one. A text's logit of a label is the label's log share of the rows, plus the sum of its log transition
    chances over the root of their number, so that long texts do not become certain. Rows without label are left out; no
    row at all is an error. What is collected and sent to the workers is bounded by the labels and BUCKETS."""
    found = counted(rows, label).collect()
    labels = tuple(sorted({r["label"] for r in found}))
    if not labels:
        raise ValueError("no labelled row to fit on")
    at = {x: i for i, x in enumerate(labels)}
    shares, counts = np.zeros(len(labels)), np.zeros((len(labels), BUCKETS))
    for r in found:
        if r["bucket"] < 0:
            shares[at[r["label"]]] = r["n"]
        else:
            counts[at[r["label"]], r["bucket"]] = r["n"]
    prior = np.log(shares / shares.sum())
    weights = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS))
    sent = rows.sparkSession.sparkContext.broadcast((prior, np.ascontiguousarray(weights.T)))

    def load() -> Forward:
        first, each = sent.value
        known: dict[tuple[str, str], int] = {}

        def forward(texts: np.ndarray) -> np.ndarray:
            out, held, size = [], [], 0
            for i, text in enumerate(texts):
                held.append(steps_of(split_words(text), known))
                size += len(held[-1])
                # The weights of many short texts are added up together.
                if size >= MOST_STEPS or i + 1 == len(texts):
                    out.append(sums(each, held))
                    held, size = [], 0
            return first + np.concatenate(out) if out else np.zeros((0, len(first)))

        return forward

    return Model(labels, load, T.lexical)


def sums(each: np.ndarray, texts: list[list[int]]) -> np.ndarray:
    """Sums of the weights of each text's steps, over the root of their number; zeros for a text without any."""
    sizes = np.array([len(x) for x in texts])
    out = np.zeros((len(texts), each.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        begins = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(each[np.concatenate([np.array(x, dtype=np.int64) for x in texts])], begins, axis=0) / np.sqrt(sizes[some])[:, None]
    return out


def learned_cascade(ruled: DataFrame, name: str = "clause_chain", threshold: float = 0.75, registry: Registry = MODELS) -> DataFrame:
    """C7 and C8 with a model that the sure rules teach: paragraphs whose rule is sure (label, confidence) are its labelled
    rows, and the others ask it. Registered under `name`. `ruled` is read three times: hand over a written table, so
    that the rules are computed once."""
    registry.register(name, fit_chain(ruled.filter(F.col("confidence") >= threshold)), replace=True)
    return classify.cascade(ruled, lambda unsure: registry.predict(unsure, name), threshold)


def representatives(predicted: DataFrame) -> DataFrame:
    """C10's model branch: of each document and predicted label but other, the paragraph that the model is surest of, ties
    to the first. predicted: (doc_id, para_idx, text, ml_label, ml_confidence)."""
    best = F.struct(F.col("ml_confidence").alias("confidence"), (-F.col("para_idx")).alias("_n"), "text")
    top = predicted.filter("ml_label <> 'other'").groupBy("doc_id", "ml_label").agg(F.max(best).alias("b"))
    return top.select("doc_id", F.col("ml_label").alias("label"), (-F.col("b._n")).alias("para_idx"), F.col("b.text").alias("text"), F.col("b.confidence").alias("confidence"))
