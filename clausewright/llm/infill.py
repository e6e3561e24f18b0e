"""Operator 13, fill-in-middle transformation: texts as ropes that are split at unit ranks, rearranged, and split back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import text_bytes, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the texts that are transformed, and percent of those that are in suffix-prefix-middle order.
RATE, SPM_RATE, SEED = 50, 80, 42
#: Bytes of a leaf, more or less: it ends with a unit, so a longer unit is a leaf of its own.
LEAF = 1024


@dataclass(frozen=True, slots=True)
class Leaf:
    """A stretch of text that ends where a unit ends."""

    data: memoryview
    units: int
    points: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    points: int


#: An empty text has no rope.
Rope = Leaf | Node | None


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where the units end: after each run of bytes that aren't ASCII white space, and after white space at the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(data))


def point_count(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def joined(left: Rope, right: Rope) -> Rope:
    """Both, one after the other, in constant time."""
    if left is None or right is None:
        return right if left is None else left
    return Node(left, right, left.units + right.units, left.points + right.points)


def balanced(parts: list[Rope]) -> Rope:
    """A rope over the parts, as deep as the logarithm of their number."""
    while len(parts) > 1:
        parts = [joined(*pair) if len(pair) == 2 else pair[0] for pair in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0] if parts else None


def rope(text: bytes) -> Rope:
    data = np.frombuffer(text, dtype=np.uint8)
    ends, view, leaves, at, done = unit_ends(data), memoryview(text), [], 0, 0
    while at < len(data):
        # At least one unit; else as many as end within the leaf.
        upto = max(done + 1, int(np.searchsorted(ends, at + LEAF, side="right")))
        end = int(ends[upto - 1])
        leaves.append(Leaf(view[at:end], upto - done, point_count(data[at:end])))
        at, done = end, upto
    return balanced(leaves)


def leaf(data: memoryview) -> Rope:
    own = np.frombuffer(data, dtype=np.uint8)
    return Leaf(data, len(unit_ends(own)), point_count(own)) if len(data) else None


def split(tree: Rope, rank: int, units: bool) -> tuple[Rope, Rope]:
    """The first `rank` units (else code points) and the rest: one way down by the cached counts, one leaf cut."""
    if tree is None:
        return None, None
    have = tree.units if units else tree.points
    if rank <= 0:
        return None, tree
    if rank >= have:
        return tree, None
    if isinstance(tree, Leaf):
        own = np.frombuffer(tree.data, dtype=np.uint8)
        at = int(unit_ends(own)[rank - 1]) if units else int(np.flatnonzero((own & 0xC0) != 0x80)[rank])
        return leaf(tree.data[:at]), leaf(tree.data[at:])
    before = tree.left.units if units else tree.left.points
    if rank <= before:
        first, rest = split(tree.left, rank, units)
        return first, joined(rest, tree.right)
    first, rest = split(tree.right, rank - before, units)
    return joined(tree.left, first), rest


def written_out(tree: Rope) -> bytes:
    parts, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, Node):
            open_ += (node.right, node.left)
        elif node is not None:
            parts.append(node.data)
    return b"".join(parts)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that hang on the seed and the id alone; a null id draws as the empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: bytes, doc_id: int | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, and of the middle) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole = rope(text)
    n = whole.units if whole else 0
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(whole, low, True)
    middle, suffix = split(rest, high - low, True)
    form, order = ("spm", [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]) if h4 % 100 < spm_rate else ("psm", [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)])
    output = reduce(joined, (part for mark, tree in order for part in (leaf(memoryview(mark)), tree)))
    return written_out(output), form, n, prefix.points if prefix else 0, middle.points if middle else 0


def restored(output: bytes, form: str) -> bytes:
    """The text that transformed() was given: its output is split behind and before each sentinel, at code points."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    # The text holds no sentinel, so each one's first place is its own.
    at = [output.index(mark) for mark in marks]
    data, rest, parts, done = np.frombuffer(output, dtype=np.uint8), rope(output), {}, 0
    for mark, begin, end in zip(marks, at, [*at[1:], len(output)]):
        _, rest = split(rest, len(mark), False)
        inside = point_count(data[begin + len(mark) : end])
        parts[mark], rest = split(rest, inside, False)
    return written_out(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


FIELDS = "doc_id long, form string, output string, n_units long, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, form (plain, psm or spm), output, n_units, and prefix_chars and middle_chars in
    code points (null if plain). Units are words with the white space before them; white space at the end is one more.
    `rate` percent of the texts, by a digest of seed and doc_id, get two cuts between units and are written as
    `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm, `spm_rate` percent of them).
    Empty texts, and texts that hold a sentinel, stay plain. Null texts are empty; a null id draws as the empty id; texts
    of any length are read whole; rows that share an id share its draws, and repeated rows repeat; an empty table gives no
    rows; other columns are not read. Nothing leaves its row, so no key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [transformed(text, i, rate, spm_rate, seed) for i, text in zip(ids, text_bytes(batch.column(1)))]
            output, form, n, prefix, middle = zip(*rows) if rows else ((),) * 5
            numbers = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()), *numbers], names=["doc_id", "form", "output", "n_units", "prefix_chars", "middle_chars"])

    return texts(docs).mapInArrow(run, FIELDS)


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (doc_id, form, output, ...) with the exact text that each came from, from form and output alone. A null
    output gives an empty text."""
    kept = [c for c in outputs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema if f.name != "text") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, output = (batch.column(batch.schema.get_field_index(c)) for c in ("form", "output"))
            text = [restored(x, f) for x, f in zip(text_bytes(output), form.to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(text, pa.binary()).cast(pa.string())], names=[*kept, "text"])

    return outputs.mapInArrow(run, schema)


def infill_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each output is restored, and both are known by their digest."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(fill_in_middle(docs)).withColumnRenamed("text", "restored").select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


_DRAW = lambda k: f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT"
INFILL_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW(2)} % 100 >= {RATE} THEN 'plain' WHEN {_DRAW(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
  least({_DRAW(0)} % (len(u) + 1), {_DRAW(1)} % (len(u) + 1)) AS low, greatest({_DRAW(0)} % (len(u) + 1), {_DRAW(1)} % (len(u) + 1)) AS high FROM t),
p AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
