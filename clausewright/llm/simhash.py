"""Operator 8, SimHash near-dedup: BK-trees over fingerprints, one per shard, followed within the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import cut, steps, text_bytes, texts
from clausewright.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that one shard's tree should hold; larger shards are divided further.
SHARD_ROWS = 1024
#: Divisions of a shard beyond the first; each fixes at least an eighth of the remaining bits.
MOST_DIVISIONS = 3


def fingerprint(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if more than half of the shingles' XXH64 values have it. Without words: 0."""
    if not words:
        return 0
    shingles = [b" ".join(w) for w in zip(*(words[i:] for i in range(size)))] if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(s, seed) for s in shingles], dtype=np.uint64, count=len(shingles))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long. Texts are lower-cased (A-Z) and read whole; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = np.array([fingerprint(x.lower().split()) for x in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Children of a node by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius, following only edges that can lead to one."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.children[node]
            if len(below) <= 2 * radius + 1:
                todo += [child for edge, child in below.items() if -radius <= edge - distance <= radius]
            else:
                todo += [below[edge] for edge in range(distance - radius, distance + radius + 1) if edge in below]
        return found

    def add(self, value: int) -> None:
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        if number:
            node = 0
            while (child := self.children[node].get(distance := (self.values[node] ^ value).bit_count())) is not None:
                node = child
            self.children[node][distance] = number


def forest(values: list[int]) -> list[tuple[int, int]]:
    """Links within RADIUS as a forest: (i, root) pairs, fewer than values, that join the same groups as all pairs."""
    tree, parent = BkTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, RADIUS):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(i, r) for i in range(len(values)) if (r := root(i)) != i]


def split_masks(mask: int, parts: int, shared: int) -> list[int]:
    """mask plus each choice of `shared` of `parts` equal pieces of the bits outside it. Two values that agree on mask
    and differ in at most parts - shared bits agree on one of the results."""
    rest = [b for b in range(64) if not mask >> b & 1]
    pieces = [sum(1 << b for b in rest[len(rest) * i // parts : len(rest) * (i + 1) // parts]) for i in range(parts)]
    return [mask | sum(choice) for choice in combinations(pieces, shared)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shard_rows(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once per mask, keyed by the bits under it."""
    listed = F.explode(F.array(*(F.lit(signed(m)).cast("long") for m in masks)))
    return rows.select("rep", "fp", listed.alias("mask")).withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def sharded(distinct: DataFrame) -> DataFrame:
    """(shard, mask, rep, fp): any two fingerprints within RADIUS share a shard.

    The bits fall into RADIUS + s pieces, and within RADIUS s of them agree; s grows with the number of fingerprints so
    that the mean shard stays small. Shards still too large (many near copies, one common piece) are divided by the
    same rule over their remaining bits. No division loses a pair."""
    total = distinct.count()
    shared = next((s for s in (1, 2, 3) if total / (1 << 64 * s // (RADIUS + s)) <= 64), 3)
    masks = split_masks(0, RADIUS + shared, shared)
    done, open_rows = [], shard_rows(distinct, masks)
    for _ in range(MOST_DIVISIONS):
        large = cut(open_rows.groupBy("shard").count().filter(F.col("count") > SHARD_ROWS).select("shard"))
        if large.isEmpty():
            break
        done.append(open_rows.join(large, "shard", "left_anti"))
        finer: dict[int, list[int]] = {m: split_masks(m, RADIUS + 1, 1) for m in masks}
        masks = [x for group in finer.values() for x in group]
        table = F.create_map(*(c for m, group in finer.items() for c in (F.lit(signed(m)).cast("long"), F.array(*(F.lit(signed(x)).cast("long") for x in group)))))
        divided = open_rows.join(large, "shard", "left_semi").select("rep", "fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        open_rows = divided.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
    for part in done:
        open_rows = open_rows.unionByName(part)
    return open_rows


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): a forest over the representatives of linked fingerprints, at most one edge per row and shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, reps, values = None, [], []

        def edges() -> list[tuple[int, int]]:
            return [(reps[i], reps[j]) for i, j in forest(values)] if len(values) > 1 else []

        for batch in batches:
            out = []
            for s, rep, fp in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != shard:
                    out += edges()
                    shard, reps, values = s, [], []
                reps.append(rep)
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])
        if out := edges():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

    rows = sharded(distinct).select("shard", "rep", "fp")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "u long, v long")


def components_of(found: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints of found: nodes within RADIUS bits are linked, and component is one
    fingerprint of those reachable."""
    distinct = cut(found.select("fp").distinct())
    components = connected_components(links(distinct.select(F.col("fp").alias("rep"), "fp")))
    return distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node; nodes within RADIUS bits are linked, and the component is named by the smallest
    doc_id of any row in it. Rows that share a doc_id and differ in text are nodes of their own: the id links nothing.
    Texts without words have fingerprint zero and are linked like others. Rows with a null doc_id get the component of
    their fingerprint (null if only such rows are in it, as they name none); texts of any length are read whole;
    repeated rows repeat; an empty table gives no rows; other columns are not read."""
    found = cut(fingerprints(docs))
    components = components_of(found)
    smallest = found.groupBy("fp").agg(F.min("doc_id").alias("least")).join(components, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = components.join(smallest, "component").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.join(named, "fp", "left").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, and where rows share that, the one
    whose text has the smallest SHA-256, whatever the order of the rows. Rows without a doc_id stay. Of rows that repeat
    id and text (null: empty) one stays. All columns stay."""
    ids, digest = F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    known = docs.filter("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = np.array([fingerprint(x.lower().split()) for x in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])

    nodes = cut(texts(known, digest.alias("digest")).mapInArrow(run, "doc_id long, digest string, fp long"))
    first = nodes.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))  # before the join: copies share a fingerprint
    least = first.join(components_of(nodes), "fp").groupBy("component").agg(F.min("first").alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("kept_id"), F.col("least.digest").alias("kept"))
    kept = known.join(chosen, (ids == chosen["kept_id"]) & (digest == chosen["kept"]), "left_semi")
    if not nodes.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).isEmpty():
        extra = "_" * (1 + max(map(len, docs.columns)))
        kept = kept.withColumn(extra, digest).dropDuplicates(["doc_id", extra]).drop(extra)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
