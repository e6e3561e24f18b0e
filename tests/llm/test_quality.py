"""Operators 4, 6, 10: quality and mixing."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from clausewright.llm.common import table
from clausewright.llm.labelled import labelled_sample
from clausewright.llm.mixing import MIX_SQL, mix, mix_digest, mixed_documents
from clausewright.llm.neighbours import classify_quality
from clausewright.llm import neighbours, rules
from clausewright.llm.rules import keep_quality, quality_rules
from tests.llm.plain import plain_rules


def test_rules_against_plain_counts(spark, small):
    extra = [None, "", "a b c d e f g h " * 30, "ü x\n\n \nü x\n" * 3, "one\x0btwo\x1cthree # <>", "w " * 8, "w " * 9]
    texts = [*extra, *(d["text"] for d in table(spark, small, "documents").collect())]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words int")
    got = {r["doc_id"]: r for r in quality_rules(docs, table(spark, small, "labels")).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(text), text
        assert not (r["kept"] and r["base_failed"])


def test_rules_tell_labels_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = quality_rules(table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("NOT base_failed")
    good, bad = got.filter("quality = 1"), got.filter("quality = 0")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert bad.filter("NOT kept").count() >= 0.9 * bad.count()


def test_rules_without_labels(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    got = quality_rules(docs, labels.filter("false"))
    assert got.filter("kept <> (NOT base_failed)").count() == 0
    kept = keep_quality(docs, labels.filter("false"))
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert quality_rules(docs.filter("false"), labels).count() == 0


def test_classifier_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = classify_quality(table(spark, sf, "documents"), labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_classifier_learns_nothing_from_the_held_out_fold(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(tuple, classify_quality(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_edges(spark, small):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (3, "x", 0.5), (3, "x", 0.5)], "doc_id long, text string, score double")
    assert {r["score"] for r in classify_quality(docs, table(spark, small, "labels").filter("false")).collect()} == {0.5}
    assert classify_quality(docs, table(spark, small, "labels")).count() == 4


def test_mixture_against_sql(spark, small):
    base = table(spark, small, "documents").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(900001, None, None), (900002, "a b", None), (900003, None, "empty"), (900004, "x " * 50, "src0"), (900005, "x y", "src0"), (900005, "x y", "src0")], base.schema)
    docs = base.unionByName(odd)
    docs_frame = docs.toPandas()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM docs_frame")
    expected = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL}) AS m").fetchall())
    got = sorted(map(tuple, mix_digest(docs).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert [g[:3] + g[4:] for g in got] == [e[:3] + e[4:] for e in expected]
    assert all(abs(g[3] - e[3]) < 1e-6 for g, e in zip(got, expected))
    assert got == sorted(map(tuple, mix_digest(docs.repartition(3)).collect()))


def test_mixture_beside_clashing_names(spark, small):
    docs = table(spark, small, "documents")
    names = ["_mix_source", "_mix_size", "__mix_tie", "mix_size", "Mix_Copies", "copy_no", "label", "count"]
    wide = docs.selectExpr("*", *(f"'x' AS `{n}`" for n in names))
    got = mixed_documents(wide)
    assert got.columns == [*docs.columns, "_mix_source", "_mix_size", "__mix_tie", "label", "count", "copy_no"]
    key = lambda df: sorted((r["doc_id"] or -1, r["copy_no"]) for r in df.select("doc_id", "copy_no").collect())
    assert key(got) == key(mixed_documents(docs))


def test_targets_by_repeated_sharing(spark, small):
    """The water level gives what cutting off and sharing anew gives in the end."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mix(docs).groupBy("source").agg({"mix_target": "first", "mix_source_size": "first"}).collect()
    size = {r["source"]: r["first(mix_source_size)"] for r in rows}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    full, total = {}, sum(size.values())
    while True:
        rest = [s for s in size if s not in full]
        share = (total - sum(full.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if share * weight[s] > 3 * size[s]]
        if not above:
            break
        full |= {s: 3 * size[s] for s in above}
    for r in rows:
        assert abs(r["first(mix_target)"] - full.get(r["source"], share * weight[r["source"]])) < 1e-6 * total


def test_mixture_comes_near_its_targets(spark):
    """Within one document of each target, and within 2 % where a source has some hundred documents."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    many = docs.crossJoin(spark.range(20)).selectExpr("doc_id * 20 + id AS doc_id", "text", "source")
    for frame, share in ((docs, 0.0), (many, 0.02)):
        found = mix_digest(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "first", "size": "max"}).collect()
        assert all(abs(r["sum(taken)"] - r["first(target)"]) < max(share * r["first(target)"], r["max(size)"] * (share == 0)) for r in found)
    assert mix_digest(docs).filter("taken > 3 * size").count() == 0
    copies = mixed_documents(docs)
    assert copies.columns == [*docs.columns, "copy_no"]
    assert copies.count() == mix(docs).agg({"mix_copies": "sum"}).first()[0]


def test_votes_against_a_plain_count(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    space = neighbours.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in classify_quality(docs, labels).collect()}
    for r in docs.limit(40).collect():
        own = space.project(neighbours.term_counts(pa.array([r["text"]])))[0]
        ranked = sorted(((float(own @ v), -i) for i, v in enumerate(space.vectors)), reverse=True)[: neighbours.NEIGHBOURS]
        weights = [max(s, 0.0) ** 4 for s, _ in ranked]
        share = sum(w * space.labels[-i] for w, (_, i) in zip(weights, ranked)) / sum(weights) if sum(weights) > 1e-9 else space.prior
        assert abs(got[r["doc_id"]] - share) < 1e-3


def test_ties_go_to_earlier_vectors():
    space = neighbours.Space(np.ones(1), np.eye(2), np.tile([[1.0, 0.0]], (40, 1)).astype(np.float32), np.array([1.0] * 15 + [0.0] * 25), 0.5)
    assert space.vote(np.array([[1.0, 0.0]], dtype=np.float32)).tolist() == [1.0]


def test_margins_against_a_plain_sum(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = rules.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    for r in docs.limit(40).collect():
        margin = model.bias
        for weights, (numbers, _) in zip(model.weights, rules.families(rules.Features(pa.array([r["text"]]), rules.BITS))):
            margin += sum(float(weights[n]) for n in numbers) / max(len(numbers), 1)
        p = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
        row = got[r["doc_id"]]
        assert abs(row["probability"] - p) < 1e-6 and row["kept"] == (not plain_rules(r["text"])[-1] and p >= rules.THRESHOLD)


def test_quality_of_long_texts_and_repeated_ids(spark, small):
    labels = table(spark, small, "labels")
    docs = spark.createDataFrame([(1, "word " * 300_000), (1, None), (1, "a b"), (2, "")], "doc_id long, text string")
    assert classify_quality(docs, labels).count() == quality_rules(docs, labels).count() == 4


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", 10).count() == 10
