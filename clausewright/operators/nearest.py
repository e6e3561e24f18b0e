"""Exact nearest neighbours that leave blocks of vectors out by bounds, before any product with their rows.

The product of a query q with any vector within distance r of a centre c is at most q.c + |q| r, whatever the lengths. The
corpus is packed in blocks by its nearest pivot. A query knows, from a bounded sample of the corpus, a similarity that its
k-th neighbour has at least; it asks its most promising cell first, which raises that, and then only the cells and blocks
whose bound reaches it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators.match import nearest
from clausewright.sources.shared import shared_folder

#: Vectors of the corpus that every task holds: all give first bounds, and among them are the cells' pivots.
SAMPLE, PIVOTS = 4096, 256
#: Vectors of a block, and blocks of a cell that one task of the join gets.
BLOCK_ROWS, SHARE = 1024, 16
#: Similarities are rounded to six places; a bound is never used more sharply than that.
SLACK = 2e-6

_FOUND = "query_id long, match_id long, similarity double"


def sample_of(corpus: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors of the corpus, those with the least digest of their id: the same ones at every run."""
    rows = corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").collect()
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the sample, each the farthest from those before it, so that every far group has one of its own and
    the reach of cells stays small. Fewer if the sample has fewer different vectors."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = batch.column(0), batch.column(1)
    return ids.to_numpy(zero_copy_only=False).astype("<i8"), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def in_cells(corpus: DataFrame, pivots: np.ndarray, rows: int = BLOCK_ROWS) -> DataFrame:
    """(cell, ids, matrix, centre, radius, reach, n): blocks of at most `rows` vectors of one cell, ids ascending, packed
    where the vectors lie, so that nothing moves and no cell is one task's. radius is about the block's own centre,
    reach about the pivot. A task holds at most `rows` vectors a pivot."""

    def block(cell: int, ids: list, parts: list) -> tuple:
        known, matrix = np.concatenate(ids), np.concatenate(parts)
        order = np.argsort(known, kind="stable")
        known, matrix = known[order], matrix[order]
        centre = matrix.mean(axis=0)
        far = lambda c: float(np.sqrt(((matrix - c) ** 2).sum(axis=1)).max())
        return cell, known.tobytes(), matrix.astype("<f4").tobytes(), centre.astype("<f8").tobytes(), far(centre), far(pivots[cell]), len(known)

    def packed(blocks: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)], ["cell", "ids", "matrix", "centre", "radius", "reach", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}
        lengths = (pivots**2).sum(axis=1)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                ids, vectors = vectors_of(batch.slice(start, rows))
                home = (lengths - 2 * vectors @ pivots.T).argmin(axis=1)
                for cell in np.unique(home).tolist():
                    mine = home == cell
                    if size.get(cell, 0) + mine.sum() > rows:
                        yield packed([block(cell, *held.pop(cell))])
                        size[cell] = 0
                    kept = held.setdefault(cell, ([], []))
                    kept[0].append(ids[mine])
                    kept[1].append(vectors[mine])
                    size[cell] = size.get(cell, 0) + int(mine.sum())
        for cell, kept in held.items():
            yield packed([block(cell, *kept)])

    return corpus.select("vec_id", "embedding").mapInArrow(run, "cell int, ids binary, matrix binary, centre binary, radius double, reach double, n long")


def asked_cells(queries: DataFrame, sample: np.ndarray, pivots: np.ndarray, reach: np.ndarray, k: int) -> DataFrame:
    """(query_id, vector, least, first, others): what the k-th neighbour has at least by the sample, the cell with the
    largest bound, and the others whose bound reaches `least`, which are PIVOTS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                ids, vectors = vectors_of(batch.slice(start, BLOCK_ROWS))
                least = np.full(len(ids), -np.inf) if len(sample) < k else np.partition(vectors @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
                bounds = vectors @ pivots.T + np.sqrt((vectors**2).sum(axis=1))[:, None] * reach
                bounds[:, reach < 0] = -np.inf
                first = bounds.argmax(axis=1)
                asked = bounds >= least[:, None] - SLACK
                asked[:, reach < 0] = False
                asked[np.arange(len(ids)), first] = False
                others = [np.flatnonzero(a).tolist() for a in asked]
                limits = [b[o].tolist() for b, o in zip(bounds, others)]
                packed = [v.astype("<f4").tobytes() for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(packed, pa.binary()), pa.array(least), pa.array(first.astype(np.int32)), pa.array(others, pa.list_(pa.int32())), pa.array(limits, pa.list_(pa.float64()))],
                    ["query_id", "vector", "least", "first", "others", "bounds"],
                )

    return queries.select("vec_id", "embedding").mapInArrow(run, "query_id long, vector binary, least double, first int, others array<int>, bounds array<double>")


def packs(asked: DataFrame) -> DataFrame:
    """(cell, qids, vectors, least): rows (query_id, vector, least, cell) in packs of one cell, as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                mine = batch.filter(pa.array(cells == cell))
                for start in range(0, mine.num_rows, BLOCK_ROWS):
                    part = mine.slice(start, BLOCK_ROWS)
                    row = [part.column("query_id").to_numpy().astype("<i8").tobytes(), b"".join(part.column("vector").to_pylist()), part.column("least").to_numpy().astype("<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["cell", "qids", "vectors", "least"])

    return asked.select("query_id", "vector", "least", "cell").mapInArrow(run, "cell int, qids binary, vectors binary, least binary")


def answers(asked: DataFrame, blocks: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(query_id, match_id, similarity): of each block that a query's bound does not rule out, its k most similar that reach
    `least`. A cell of many blocks is dealt over as many keys as its size asks for."""
    shares = F.broadcast(cells.select("cell", "shares"))
    left = packs(asked).join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    right = blocks.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("ids"), F.col("shares")).cast("int"))
    pairs = left.join(right, ["cell", "share"]).select("qids", "vectors", "least", "ids", "matrix", "centre", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_buffer() for j in range(6)]
                asking, least, known = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[2], "<f8"), np.frombuffer(raw[3], "<i8")
                vectors = np.frombuffer(raw[1], "<f4").astype(np.float64).reshape(len(asking), -1)
                bound = vectors @ np.frombuffer(raw[5], "<f8") + np.sqrt((vectors**2).sum(axis=1)) * batch.column(6)[i].as_py()
                open_ = bound >= least - SLACK
                if not open_.any():
                    continue
                matrix = np.frombuffer(raw[4], "<f4").astype(np.float64).reshape(len(known), -1)
                products = np.round(vectors[open_] @ matrix.T, 6)
                at, to = nearest(products, k)
                good = products[at, to] >= least[open_][at] - SLACK
                at, to = at[good], to[good]
                yield pa.RecordBatch.from_arrays([pa.array(asking[open_][at]), pa.array(known[to]), pa.array(products[at, to])], ["query_id", "match_id", "similarity"])

    return pairs.mapInArrow(run, _FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_pruned(queries: DataFrame, corpus: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE, report: bool = False):
    """J3 and J4 for free-standing vectors of one length (vec_id, embedding): (query_id, match_id, similarity, rank), exact,
    similarity to six places, ties to the smaller id; the rows of match.top_k_blocked, without its cross join. Rows with a
    null id or vector are left out; without corpus or queries the result is empty. vec_id is unique on either side.
    With report, also (query_id, n_cells, n_asked): how many cells there are and how many each query went to."""
    whole = "vec_id IS NOT NULL AND embedding IS NOT NULL"
    asking, known = (d.filter(whole).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")) for d in (queries, corpus))
    spark = corpus.sparkSession
    folder = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    seen = sample_of(known, sample)
    if not len(seen):
        empty = spark.createDataFrame([], _FOUND + ", rank int")
        return (empty, spark.createDataFrame([], "query_id long, n_cells int, n_asked int")) if report else empty

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    centres = spread_pivots(seen, pivots)
    blocks = written(in_cells(known, centres), "blocks")
    cells = written(blocks.groupBy("cell").agg(F.max("reach").alias("reach"), F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")), "cells")
    reach = np.full(len(centres), -1.0)
    for row in cells.collect():  # a row a pivot at most
        reach[row["cell"]] = row["reach"]
    asked = written(asked_cells(asking, seen, centres, reach, k), "asked")
    near = written(best_of(answers(asked.withColumn("cell", F.col("first")), blocks, cells, k), k), "near")
    raised = near.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("_s"))
    sharper = asked.join(raised, "query_id", "left").withColumn("least", F.greatest("least", F.coalesce("_s", F.lit(float("-inf")))))
    rest = sharper.withColumn("o", F.explode(F.arrays_zip("others", "bounds"))).filter(F.col("o.bounds") >= F.col("least") - SLACK).withColumn("cell", F.col("o.others"))
    found = best_of(near.drop("rank").unionByName(answers(rest, blocks, cells, k)), k)
    if not report:
        return found
    further = rest.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    counts = asked.join(further, "query_id", "left").select("query_id", F.lit(int((reach >= 0).sum())).alias("n_cells"), (F.coalesce("_n", F.lit(0)) + 1).alias("n_asked"))
    return found, counts
