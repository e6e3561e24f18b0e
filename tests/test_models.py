"""The model registry, the chain model against a plain forward pass, and pruned search against plain products."""

from __future__ import annotations

import hashlib
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import match, models, nearest
from clausewright.plans.queries import QUERIES

ROWS = [("the fee is due within ten days", "payment"), ("the fee is paid in advance", "payment"), ("either party may end this agreement", "termination"), ("this agreement ends at once", "termination"), ("the court of london", "law")]
ASKED = ["the fee is due", "agreement ends", "", None, "   ", "zebra", "Ünïted, the COURT of London!", "the fee " * 3000]


def plain_forward(text: str) -> tuple[str, float]:
    """Chances by counting words in loops."""
    def steps(t):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return [int(hashlib.md5(f"{a} {b}".encode()).hexdigest()[:7], 16) % models.BUCKETS for a, b in zip(["^", *words], words)]

    scores = {}
    for label in sorted({y for _, y in ROWS}):
        seen = [s for t, y in ROWS if y == label for s in steps(t)]
        score = math.log(sum(y == label for _, y in ROWS) / len(ROWS))
        mine = steps(text)
        scores[label] = score + sum(math.log((seen.count(s) + 1) / (len(seen) + models.BUCKETS)) for s in mine) / math.sqrt(max(len(mine), 1))
    top = max(scores.values())
    best = min(k for k, v in scores.items() if v == top)
    return best, 1 / sum(math.exp(v - top) for v in scores.values())


def test_chain_model_is_the_plain_forward_pass(spark):
    registry = models.Registry()
    labelled = spark.createDataFrame([*ROWS, ("no label", None)], "text string, label string")
    registry.register("chain", models.fit_chain(labelled))
    asked = spark.createDataFrame(list(enumerate(ASKED)), "i int, text string").withColumn("ml_label", F.lit("clash"))
    rows = {r["i"]: r for r in registry.predict(asked, "chain").collect()}
    assert len(rows) == len(ASKED)
    for i, text in enumerate(ASKED):
        label, score = plain_forward(text)
        assert rows[i]["ml_label"] == label and abs(rows[i]["ml_confidence"] - score) < 6e-5
    gated = registry.predict(asked, "chain", least=1.1)
    assert {r["ml_label"] for r in gated.collect()} == {"other"}
    assert registry.predict(asked.limit(0), "chain").count() == 0


def test_fit_without_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="no labelled row"):
        models.fit_chain(spark.createDataFrame([("x", None)], "text string, label string"))


def test_registry(spark):
    registry = models.Registry()
    model = models.Model(("a", "b"), lambda: lambda texts: np.zeros((len(texts), 2)))
    registry.register("m", model)
    with pytest.raises(ValueError, match="already"):
        registry.register("m", model)
    with pytest.raises(ValueError, match="no labels"):
        registry.register("n", models.Model((), model.load))
    with pytest.raises(KeyError, match="registered: m"):
        registry.get("n")
    registry.register("m", model, replace=True)
    assert registry.names() == ["m"]


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    registry = models.Registry()
    registry.register("length", models.Model(("long", "short"), load))
    rows = spark.range(2000).repartition(16).select(F.col("id"), F.lit("abc").alias("text"))
    assert registry.predict(rows, "length", batch=10).filter("ml_label = 'long'").count() == 2000
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))


def test_model_decides_only_where_rules_are_unsure(spark):
    ruled = spark.createDataFrame([(1, i, t, y, 1.0) for i, (t, y) in enumerate(ROWS)] + [(1, 9, "the fee is due", "law", 0.2), (1, 10, None, "other", 0.0)], "doc_id int, para_idx int, text string, label string, confidence double")
    rows = {r["para_idx"]: r for r in models.learned_cascade(ruled, "t", registry=models.Registry()).collect()}
    assert len(rows) == 7 and all(rows[i]["method"] == "rule_based" and rows[i]["ml_confidence"] is None for i in range(5))
    assert (rows[9]["label"], rows[9]["method"]) == ("payment", "ml_fallback")


def test_representatives_tie_to_the_first(spark):
    rows = spark.createDataFrame([(1, 2, "b", "law", 0.9), (1, 1, "a", "law", 0.9), (1, 0, "c", "law", 0.5), (1, 3, "d", "other", 1.0)], "doc_id int, para_idx int, text string, ml_label string, ml_confidence double")
    assert [tuple(r) for r in models.representatives(rows).collect()] == [(1, "law", 1, "a", 0.9)]


def clustered(n: int, groups: int, seed: int = 3, spread: float = 0.05, unit: bool = True) -> np.ndarray:
    """Vectors around a few centres; a third of them in the first group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    home = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    rows = centres[home] + spread * rng.normal(size=(n, 16))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if unit else rows * rng.uniform(0.2, 3, (n, 1))


@pytest.mark.parametrize("unit", [True, False])
def test_pruned_search_is_exact_and_rules_cells_out(spark, monkeypatch, unit):
    monkeypatch.setattr(nearest, "SHARE", 1)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 64)
    rows = clustered(3000, 40, unit=unit)
    rows[100:140] = rows[100]  # ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    queries = corpus.filter("vec_id % 20 = 0")
    found, asked = nearest.top_k_pruned(queries, corpus, 5, pivots=64, sample=256, report=True)
    key = lambda r: (r["query_id"], r["match_id"], round(r["similarity"], 6), r["rank"])
    assert sorted(map(key, found.collect())) == sorted(map(key, match.top_k_blocked(queries, corpus, 5).collect()))
    share = asked.agg(F.sum("n_asked") / F.sum("n_cells")).first()[0]
    assert share < (0.15 if unit else 0.7)


def test_pruned_search_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, similarity string"
    few = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (None, [1.0, 1.0], "x"), (3, None, "x")], schema)
    rows = nearest.top_k_pruned(few, few, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1.0, 1), (1, 2, 0.0, 2), (2, 2, 1.0, 1), (2, 1, 0.0, 2)]
    none = few.limit(0)
    assert nearest.top_k_pruned(few, none, 5).count() == 0 and nearest.top_k_pruned(none, few, 5).count() == 0


def test_classifier_is_fitted_on_written_rows(spark, monkeypatch):
    """the many passes of a fit read a table, not the rules and ranks that made it."""
    seen = []
    monkeypatch.setattr("clausewright.operators.learn.train", lambda rows: seen.append(rows) or (lambda other: other.withColumn("ml_label", F.col("label"))))
    QUERIES["clause_classifier"](spark, "/root/testdata/sf0.001").collect()
    assert all("/split-" in f for f in seen[0].inputFiles()) and "regexp_count" not in seen[0]._jdf.queryExecution().toString()


def test_search_holds_few_products_at_once(spark, monkeypatch):
    """F16: a block of queries meets a block of vectors in parts, with the same rows as plain products."""
    choose = np.random.default_rng(3)
    rows = [(i, [float(x) for x in choose.normal(size=4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    own = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    monkeypatch.setattr(match, "QUERY_ROWS", 7)
    plain = match.nearest

    def narrow(found, k):
        assert found.shape[0] <= 7
        return plain(found, k)

    monkeypatch.setattr(match, "nearest", narrow)
    products = np.round(own @ own.T, 6)
    expected = {(q, int(m), r) for q in range(60) for r, m in enumerate(np.argsort(-products[q], kind="stable")[:5], 1)}
    assert {(r["query_id"], r["match_id"], r["rank"]) for r in match.top_k_blocked(vectors, vectors, 5).collect()} == expected


def test_steps_are_counted_in_tasks(spark):
    """a fit moves a count for each label and bucket of a task, not a row for each step."""
    rows = spark.createDataFrame([*ROWS, (None, "law"), ("x", None)], "text string, label string").coalesce(1)
    counts = models.counted(rows, "label")
    assert "md5" not in counts._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["label"], r["bucket"]): r["n"] for r in counts.collect()}
    assert found[("law", -1)] == 2 and found[("payment", -1)] == 2 and sum(n for (label, b), n in found.items() if label == "law" and b >= 0) == 4
    each = np.arange(12.0).reshape(4, 3)
    texts = [[], [1, 1, 2], [], [3], []]
    assert np.allclose(models.sums(each, texts), [each[t].sum(axis=0) / math.sqrt(max(len(t), 1)) for t in texts])
