"""Operator 9, benchmark decontamination: one Aho-Corasick automaton of all item windows, one scan of every text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import STEP_BYTES, steps, text_bytes, texts
from clausewright.llm.words import gaps, padded, plain_spans, plain_words

WINDOW = 10
#: Text bytes of the benchmark that one automaton holds (some 300 bytes of memory for each); a larger benchmark is
#: scanned for in several blocks, one after another over ROUND_BYTES of text.
BLOCK_BYTES, ROUND_BYTES = 1_000_000, 32_000_000
#: Text bytes that a benchmark, the stated query set, may have: it passes through the driver. A larger one is an error.
MOST_BYTES = 64_000_000


def item_blocks(benchmark: DataFrame, limit: int) -> list[list[tuple[str, bytes]]]:
    """Items as (id as text, words joined by one space), in blocks of `limit` bytes. The benchmark is the stated query
    set; it comes to the driver row by row, up to MOST_BYTES."""
    blocks: list[list[tuple[str, bytes]]] = [[]]
    held = total = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = b" ".join(plain_words((row["text"] or "").encode()))
        total += len(words)
        if total > MOST_BYTES:
            raise ValueError(f"the benchmark has more than {MOST_BYTES} bytes of words")
        if held and held + len(words) > limit:
            blocks.append([])
            held = 0
        blocks[-1].append((row["item"], words))
        held += len(words)
    return blocks


class Windows:
    """The automaton of one block: each distinct window once, with its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        found: dict[bytes, tuple[int, set[str]]] = {}
        for item, joined in items:
            words = joined.split()
            for i in range(max(1, len(words) - size + 1) if words else 0):
                part = words[i : i + size]
                found.setdefault(padded(part), (len(part), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key.decode("latin-1"), value)
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def search(self, joined: bytes) -> list[tuple[int, int, set[str]]]:
        """(place of the space after the window, its words, its items) of every occurrence."""
        return [(end, n, items) for end, (n, items) in self.automaton.iter(joined.decode("latin-1"))] if self.any else []


def rounds(batches: Iterator[pa.RecordBatch], text: str, blocks: int) -> Iterator[pa.RecordBatch]:
    """Steps of rows; where several automata take turns, ROUND_BYTES of text at a time, so that each is seldom built."""
    return steps(batches, text, ROUND_BYTES if blocks > 1 else STEP_BYTES)


class Scan:
    """The blocks' automata, of which one is held at a time."""

    def __init__(self, blocks: list, size: int):
        self.blocks, self.size, self.held = blocks, size, (-1, None)

    def windows(self) -> Iterator[Windows]:
        for k, block in enumerate(self.blocks):
            if self.held[0] != k:
                self.held = (k, Windows(block.value, self.size))
            yield self.held[1]


SCHEMA = "doc_id long, n_words long, items array<string>, hits array<struct<word:long,n_words:long,start:long,end:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, items (ids of the benchmark items of which a window occurs, sorted) and
    hits (maximal runs of covered words: first word, count, and the run's span in code points of the original text).
    Null texts and texts without words have no hits; null item ids count as the empty id; rows that share an id are one
    item; an empty benchmark contaminates nothing; texts of any length are read whole; an empty table gives no rows;
    repeated rows repeat; other columns are not read."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in item_blocks(benchmark, block_bytes)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Scan(blocks, size)
        out = pa.list_(pa.struct([(k, pa.int64()) for k in ("word", "n_words", "start", "end")]))
        for batch in rounds(batches, "text", len(blocks)):
            data = text_bytes(batch.column(1))
            counts: list[int] = [0] * len(data)
            found: list[list] = [[] for _ in data]
            for windows in search.windows():
                for i, x in enumerate(data):
                    words = plain_words(x)
                    counts[i] = len(words)
                    found[i] += windows.search(padded(words))
            items = [sorted(set().union(*(h[2] for h in hits))) if hits else [] for hits in found]
            runs = [covered(d, padded(plain_words(d)), n, hits) if hits else [] for d, n, hits in zip(data, counts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, out)], ["doc_id", "n_words", "items", "hits"])

    return texts(docs).mapInArrow(scan, SCHEMA)


def covered(data: bytes, joined: bytes, n_words: int, hits: list[tuple[int, int, set[str]]]) -> list[dict]:
    """Maximal runs of words inside any occurrence."""
    last = np.searchsorted(gaps(joined), [h[0] for h in hits])
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, last - [h[1] for h in hits], 1)
    np.add.at(change, last, -1)
    inside = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
    starts, ends = plain_spans(data)
    return [{"word": int(a), "n_words": int(b - a), "start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edges[0::2], edges[1::2])]


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination, and hits: its runs as start:end in code points, comma-joined."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["n_words"])
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("hits"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; all columns stay. Rows with a null text stay."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in item_blocks(benchmark, BLOCK_BYTES)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Scan(blocks, WINDOW)
        for batch in rounds(batches, "text", len(blocks)):
            data = text_bytes(batch.column(batch.schema.get_field_index("text")))
            clean = np.ones(len(data), dtype=bool)
            for windows in search.windows():
                for i, x in enumerate(data):
                    if clean[i] and windows.search(padded(plain_words(x))):
                        clean[i] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
