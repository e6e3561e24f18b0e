"""Comparing two versions of a contract: embeddings, nearest neighbours, status, added clauses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators.segment import split_structural

IDENTICAL, MODIFIED, RELATED = 0.90, 0.75, 0.60
DIMENSIONS = 256
#: Indices that one block spans: as many vectors at most, far fewer where a contract's indices have gaps.
BLOCK_ROWS = 8192
#: Queries of a block whose products with a block of the corpus stand at once.
QUERY_ROWS = 256
#: Pairs that leave a worker at once, and words whose buckets it keeps.
OUT_ROWS, MOST_KNOWN = 50_000, 200_000
#: Products that are made at once, and pairs that are put in order before they leave, where all are asked for.
PRODUCTS, MOST_PAIRS = 1 << 20, 1 << 23
#: Parts into which the blocks of a contract's second version are dealt where all pairs are asked for.
PARTS = 8


def preprocess(clauses: DataFrame) -> DataFrame:
    """(doc_id, idx, clause): normalised, empties gone, the first of equal ones, numbered anew from 0."""
    named = clauses.select("doc_id", "para_idx", T.normalise_clause(F.col("text")).alias("clause")).filter("clause <> ''")
    firsts = named.groupBy("doc_id", "clause").agg(F.min("para_idx").alias("para_idx"))
    return firsts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx")) - 1).alias("idx"), "clause")


def worded(clauses: DataFrame) -> DataFrame:
    """clauses with `words`: their words between single spaces, from which J2's default model makes vectors."""
    return clauses.withColumn("words", T.lexical(F.col("clause")))


def unit_counts(texts: Iterable[str | None], dimensions: int = DIMENSIONS, known: dict[str, int] | None = None) -> np.ndarray:
    """Vectors of texts of words: hashed words and word pairs, unit length, in single precision. known: buckets found
    before, kept by the caller and emptied when there are many."""
    known, found, sizes = {} if known is None else known, [], []
    if len(known) > MOST_KNOWN:
        known.clear()
    for text in texts:
        own = [w for w in (text or "").split(" ") if w]
        own += [f"{a} {b}" for a, b in zip(own, own[1:])]
        for w in own:
            if w not in known:
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dimensions
        found += [known[w] for w in own]
        sizes.append(len(own))
    at = np.repeat(np.arange(len(sizes)) * dimensions, sizes) + np.array(found, dtype=np.int64)
    counts = np.bincount(at, minlength=len(sizes) * dimensions).astype(np.float64).reshape(-1, dimensions)
    return (counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def embed(clauses: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """J2's default model: hashed words and word pairs, unit length; adds `vector`, the same anywhere."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(unit_counts(texts, dimensions)))

    return worded(clauses).withColumn("vector", run("words")).drop("words")


def embed_with(clauses: DataFrame, encode) -> DataFrame:
    """J2 with a model: encode maps a pandas Series of clauses to lists of floats, a batch at a time; made unit length."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = np.asarray(encode(texts), dtype=np.float64)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(rows.astype(np.float32)))

    return clauses.withColumn("vector", run("clause"))


def in_blocks(clauses: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, _k, block): what stands for the clauses of a contract (`vector`, else `words`) by index, at most `rows` in
    a block."""
    held = F.col("vector").cast("array<float>").alias("vector") if "vector" in clauses.columns else F.col("words")
    numbered = clauses.select("doc_id", F.floor(F.col("idx") / rows).alias("_k"), F.struct(F.col("idx").cast("int").alias("idx"), held).alias("v"))
    return numbered.groupBy("doc_id", "_k").agg(F.array_sort(F.collect_list("v"), lambda a, b: a["idx"] - b["idx"]).alias("block"))


def block_of(column: pa.ListArray, row: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and vectors (in double) of a row's block; words become vectors only here, so that no vector moves."""
    inner = column[row].values
    idx = inner.field("idx").to_numpy(zero_copy_only=False)
    if inner.type.get_field_index("vector") < 0:
        return idx, unit_counts(inner.field("words").to_pylist(), known=known).astype(np.float64)
    return idx, inner.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(inner), -1)


def nearest(products: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest products of each row (ties: the earlier column), or of all."""
    n, m = products.shape
    if k is None or k >= m:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    found = products.argmax(axis=1)[:, None] if k == 1 else np.argsort(-products, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(n), k), found.ravel()


def block_similarities(a: DataFrame, b: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, idx_a, idx_b, similarity) of the clauses of one contract: all pairs, or for each clause of a the k most
    similar of every block of b. Blocks meet in an equi-join on the contract, matrix products of so many rows at a time,
    so neither pairs nor vectors become rows. All pairs of a large contract are the work of several tasks, and leave a
    worker by similarity: equal values lie together, which halves what files of them take."""

    names, ordered = ["doc_id", "idx_a", "idx_b", "similarity"], k is None
    most = MOST_PAIRS if ordered else OUT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        # Rows of the batch and what was found there; pages that are not filled take no memory.
        kept = [np.empty(most + PRODUCTS, dtype=t) for t in (np.int32, np.int32, np.int32, np.float64)]

        def leave(contracts: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
            order = np.argsort(kept[3][:size]) if ordered else np.arange(size)
            for i in range(0, size, OUT_ROWS):
                rows, *found = (c[order[i : i + OUT_ROWS]] for c in kept)
                yield pa.RecordBatch.from_arrays([contracts.take(pa.array(rows)), *map(pa.array, found)], names)

        for batch in batches:
            size = 0
            for row in range(batch.num_rows):
                (idx_a, left), (idx_b, right) = (block_of(batch.column(i), row, known) for i in (1, 2))
                step = max(PRODUCTS // max(len(idx_b), 1), 1)
                for i in range(0, len(idx_a), step):
                    products = np.round(left[i : i + step] @ right.T, 6)
                    at, to = nearest(products, k)
                    for c, values in zip(kept, (row, idx_a[i : i + step][at], idx_b[to], products[at, to])):
                        c[size : size + len(at)] = values
                    size += len(at)
                    # Small contracts leave together: a batch for each would cost more than its products.
                    if size >= most:
                        yield from leave(batch.column(0), size)
                        size = 0
            yield from leave(batch.column(0), size)

    own, other, keys = in_blocks(a).withColumnRenamed("block", "_a"), in_blocks(b).withColumnRenamed("block", "_b"), ["doc_id"]
    if k is None:
        # Contracts may be few, and their pairs many: every block of a goes to each part of b's blocks. Tasks are made by
        # what they read, and small blocks have much work: a broadcast would leave the pairs to a few of them.
        own, keys = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["doc_id", "_part"]
        other = other.withColumn("_part", F.pmod("_k", F.lit(PARTS)).cast("int")).hint("merge")
    pairs = own.drop("_k").join(other.drop("_k"), keys).select("doc_id", "_a", "_b")
    return pairs.mapInArrow(run, f"doc_id {a.schema['doc_id'].dataType.simpleString()}, idx_a int, idx_b int, similarity double")


def similarities(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, idx_a, idx_b, similarity) of all pairs of one contract's clauses."""
    return block_similarities(a, b)


def matrix(pairs: DataFrame, columns: int) -> DataFrame:
    """J8's wide form for up to `columns` clauses of b."""
    return pairs.groupBy("doc_id", "idx_a").pivot("idx_b", list(range(columns))).agg(F.first("similarity"))


def best(a: DataFrame, b: DataFrame) -> DataFrame:
    """J4 with k = 1: the most similar b of each a, ties to the smaller index."""
    top = block_similarities(a, b, 1).groupBy("doc_id", "idx_a").agg(F.max(F.struct("similarity", (-F.col("idx_b")).alias("n"))).alias("t"))
    return top.select("doc_id", "idx_a", F.col("t.similarity").alias("similarity"), (-F.col("t.n")).alias("idx_b"))


def top_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The k most similar, ranked: of every block k reach the ranking."""
    order = Window.partitionBy("doc_id", "idx_a").orderBy(F.desc("similarity"), "idx_b")
    return block_similarities(a, b, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def packed_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, matrix): vectors (vec_id, embedding) in blocks of at most `rows`, as they lie in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([flat], pa.binary())], ["ids", "matrix"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "ids binary, matrix binary")


def top_k_blocked(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """J3 and J4 for free-standing vectors of one length: (query_id, match_id, similarity, rank), exact, ties to the
    smaller id. Both sides are packed where they lie; every block of the stated queries meets every block of the corpus
    in one matrix product, of which k per query are ranked at last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                asked, known = (np.frombuffer(row[i], "<i8") for i in (0, 2))
                left, right = (np.frombuffer(row[i], "<f4").astype(np.float64).reshape(n, -1) for i, n in ((1, len(asked)), (3, len(known))))
                order = np.argsort(known, kind="stable")
                turned = right[order].T
                # Some queries at a time: products of two whole blocks, and their order, would be several hundred MB.
                for i in range(0, len(asked), QUERY_ROWS):
                    products = np.round(left[i : i + QUERY_ROWS] @ turned, 6)
                    at, to = nearest(products, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i : i + QUERY_ROWS][at]), pa.array(known[order][to]), pa.array(products[at, to])], ["query_id", "match_id", "similarity"])

    asked = packed_blocks(queries, block_rows).select(F.col("ids").alias("_q"), F.col("matrix").alias("_a"))
    pairs = asked.crossJoin(packed_blocks(corpus, block_rows)).mapInArrow(run, "query_id long, match_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def change_status(similarity: Column, identical: float = IDENTICAL, modified: float = MODIFIED, related: float = RELATED) -> Column:
    return F.when(similarity >= identical, "identical").when(similarity >= modified, "modified").when(similarity >= related, "related").otherwise("removed")


def classify_changes(a: DataFrame, b: DataFrame, identical: float = IDENTICAL, modified: float = MODIFIED, related: float = RELATED) -> DataFrame:
    """(doc_id, status, idx_a, idx_b, clause_a, clause_b, similarity). A removed clause keeps its best
    similarity, but no partner; added clauses of b are those that no clause of a has as an at least related best. If b has
    no clause at all, every clause of a is removed at -1. a and b: (doc_id, idx, clause, vector or words)."""
    found = a.select("doc_id", F.col("idx").alias("idx_a"), F.col("clause").alias("clause_a")).join(best(a, b), ["doc_id", "idx_a"], "left")
    judged = found.withColumn("similarity", F.coalesce("similarity", F.lit(-1.0))).withColumn("status", change_status(F.col("similarity"), identical, modified, related))
    matched = judged.withColumn("idx_b", F.when(F.col("status") != "removed", F.col("idx_b")))
    right = b.select("doc_id", F.col("idx").cast("int").alias("idx_b"), F.col("clause").alias("clause_b"))
    # One full join: a side without partner is a removed clause, or an added one.
    both = matched.join(right, ["doc_id", "idx_b"], "full").withColumn("status", F.coalesce("status", F.lit("added")))
    return both.select("doc_id", "status", "idx_a", "idx_b", "clause_a", "clause_b", "similarity")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """J7 and J9 on paragraphs (doc_id, para_idx, text) of both versions."""
    return classify_changes(worded(preprocess(a)), worded(preprocess(b)))


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts per contract and the sentence; identical and related are unchanged or similar."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = changes.groupBy("doc_id").agg(n("added").alias("n_added"), n("removed").alias("n_removed"), n("modified").alias("n_modified"), n("identical", "related").alias("n_similar"))
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" clause(s) {what}")))
    sentence = F.concat_ws(". ", part("n_added", "added"), part("n_removed", "removed"), part("n_modified", "modified"), part("n_similar", "unchanged or similar"))
    return counts.withColumn("change_summary", F.when(sentence == "", "No differences detected.").otherwise(F.concat(sentence, F.lit("."))))


def comparable(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Requests (id_a, id_b) with the first problem: the same contract twice, or one that is not registered."""
    known = contracts.select("contract_id").distinct()
    a, b = known.select(F.col("contract_id").alias("_a")), known.select(F.col("contract_id").alias("_b"))
    joined = requests.join(a, F.col("id_a") == F.col("_a"), "left").join(b, F.col("id_b") == F.col("_b"), "left")
    return joined.withColumn("problem", F.when(F.col("id_a") == F.col("id_b"), "same_contract").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_contract")).drop("_a", "_b")


def compare_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The comparison of whole texts (doc_id, text), split into paragraphs first."""
    return compare(split_structural(a), split_structural(b))


#: The lists of a comparison's answer and the statuses in each.
RESPONSE = {"removed_clauses": ("removed",), "modified_clauses": ("modified",), "similar_clauses": ("identical", "related")}


def response(changes: DataFrame, contracts: DataFrame) -> DataFrame:
    """One typed row per contract of `contracts` (doc_id): added_clauses, as texts, and lists of items (clause_a,
    clause_b, similarity, status), in order; lists without items are empty. Identical ones come before related ones."""
    item = F.struct(F.coalesce("clause_a", F.lit("")).alias("clause_a"), "clause_b", F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), "status")

    def listed(statuses: tuple[str, ...], value: Column) -> Column:
        place = F.struct(*(F.col(c) for c in ("status", "idx_a", "idx_b")), value.alias("v"))
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("status").isin(*statuses), place))), lambda x: x["v"])

    named = changes.groupBy("doc_id").agg(listed(("added",), F.col("clause_b")).alias("added_clauses"), *(listed(s, item).alias(n) for n, s in RESPONSE.items()))
    items = "array<struct<clause_a:string,clause_b:string,similarity:double,status:string>>"
    filled = [F.coalesce(n, F.array().cast("array<string>" if n == "added_clauses" else items)).alias(n) for n in ("added_clauses", *RESPONSE)]
    return contracts.select("doc_id").distinct().join(named, "doc_id", "left").select("doc_id", *filled)


def report(changes: DataFrame, output_format: str = "dict") -> DataFrame:
    """SK4: one row per contract: `dict` as JSON of the lists by status, `text` as lines, `report` as typed lists."""
    if output_format == "text":
        return report_text(changes)
    typed = response(changes, changes)
    if output_format == "report":
        return typed
    if output_format == "dict":
        return typed.select("doc_id", F.to_json(F.struct(*typed.columns[1:])).alias("report"))
    raise ValueError(f"output format {output_format!r}: choose dict, text or report")


def report_text(changes: DataFrame) -> DataFrame:
    """SK4: one text per contract, a line for every change in order."""
    line = F.format_string("[%s] %s -> %s", "status", F.coalesce("clause_a", F.lit("-")), F.coalesce("clause_b", F.lit("-")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("idx_a", F.lit(2**31 - 1)).alias("a"), F.coalesce("idx_b", F.lit(-1)).alias("b"), line.alias("line"))))
    return changes.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))
