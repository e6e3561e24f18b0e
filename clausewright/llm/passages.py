"""Operator 7, substring dedup: fuzzy passages from collinear chains of shared word seeds.

A seed is a run of five words; all seeds count. Each seed of a document is matched with the first place that has it, and
with the first that has it within the same MIN_WORDS words, its holders: a passage in a third of all documents costs two
matches per document and seed at most, never a pair of documents each, and MIN_WORDS equal words always meet. Seeds and
matches move packed, in buckets: those that only one place has never become rows. Matches of one document and holder are
chained in order, gaps cost what they skip, and a chain is aligned word by word between its seeds. Passages of MIN_WORDS
words or more, alike to 0.8 or more, are the result.

A passage that several earlier documents hold in parts meets none that holds all of it by its first holders. But in any
two documents that have it the same holders stand side by side: each such pair leads to the first document that has it,
and what both share with the holders is what they share with each other.

Three kinds of matches are settled before any text moves. Documents with the same words as an earlier one are its copies
as a whole. A chain that is one run of fewer than MIN_WORDS words needs equal words beside it: four bits of a hash of
each neighbour show where that cannot be, and only the chains that remain ask for the holder's words. And a match within
the same MIN_WORDS words adds nothing where chains of first holders are sure to be passages around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import STEP_BYTES, RollingHash, joined_bytes, merged, mix64, numbered, removed, steps, text_bytes, written
from clausewright.llm.packing import packed, parcels, unpacked
from clausewright.llm.words import blank_spans, plain_words

SEED_WORDS = 5
SIMILARITY, MIN_WORDS = 0.8, 25
#: Cost of a skipped word on either side; words between two seeds of a chain at most; words of one tile of a holder.
GAP_COST, MOST_GAP, TILE = 0.1, 40, 32
#: A growing end is given up so far below its best.
GIVE_UP = 8
#: Words of a holder sent beyond either end of a chain at first, and how many times as many when a chain outgrows them.
REACH, FURTHER = 26, 8
#: Words of the chains of two holders that stand side by side in a document, at least, for it to be looked up by them.
JOINT_WORDS = 7
#: Neighbours on either side of a short run whose hashes are compared first.
BESIDE = 24
#: Seeds that share a bucket, on average; seeds of the texts that one parcel of every bucket is made from.
BUCKET_SEEDS, PARCEL_SEEDS = 1_000_000, 1_000_000
#: Rows of one Arrow batch of results.
BATCH_ROWS = 20_000


def places_of(doc: np.ndarray) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64)) >> np.uint64(1)).astype(np.int64)


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, place, n_words, digest, body): the plain words of each text, joined by spaces and compressed, and
    their SHA-256. place deals documents into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in steps(batches):
            words = [plain_words(x) for x in text_bytes(batch.column(2))]
            joined = [b" ".join(w) for w in words]
            place = places_of(batch.column(1).to_numpy(zero_copy_only=False))
            columns = [pa.array(place), pa.array(map(len, words), pa.int64(), size=len(words)), pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()), pa.array(list(map(shrink, joined)), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "doc", "place", "n_words", "digest", "body"])

    return docs.select("doc_id", "doc", "text").mapInArrow(run, "doc_id long, doc long, place long, n_words long, digest binary, body binary")


def opened(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Steps of rows with the words of their bodies, joined by spaces."""
    grow = zstandard.ZstdDecompressor().decompress
    for batch in steps(batches, "body", STEP_BYTES // 8):
        yield batch, [grow(x) for x in batch.column(column).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and the place of each text's first word (one more: the end)."""
    data, starts, _ = joined_bytes(pa.array(texts, pa.binary()), 1)
    begin, end = blank_spans(data)
    return RollingHash(data).ranges(begin, end), np.searchsorted(begin, np.append(starts, len(data)))


def hash_bits(n_words: int) -> int:
    """Bits of a seed's hash: of so many, one seed in a million shares one with an unlike seed (they are told apart by
    words, but the earlier of the two stands for both)."""
    return min(62, (n_words + 1).bit_length() + 20)


def all_seeds(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, hash, 24-bit hash of the MIN_WORDS words from there or 0) of each run of SEED_WORDS
    words."""
    word, first = word_hashes(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(word) - SEED_WORDS + 1)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(SEED_WORDS):
        run = run * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n]
    wide, m = np.zeros(n, dtype=np.uint64), len(word) - MIN_WORDS + 1
    if m > 0:
        long = np.zeros(m, dtype=np.uint64)
        for i in range(MIN_WORDS):
            long = long * np.uint64(0x9E3779B97F4A7C15) + word[i : i + m]
        wide[:m] = np.where(doc[:m] == doc[MIN_WORDS - 1 :], np.maximum(mix64(long) >> np.uint64(40), np.uint64(1)), np.uint64(0))
    place = np.flatnonzero(doc[:n] == doc[SEED_WORDS - 1 :]) if n else np.zeros(0, np.int64)
    return doc[place], place - first[doc[place]], mix64(run[place]) >> np.uint64(64 - bits), wide[place]


#: Bytes by which seeds (steps between sorted ones), documents (places in a sorted list), words and the hashes of the
#: MIN_WORDS words that a seed begins are packed; then documents, holders, words, diagonals and kinds of matches.
_SEED_WIDTHS, _MATCH_WIDTHS = (8, 4, 4, 3), (8, 8, 4, 5, 1)
_PARCEL = "bucket long, n long, n_ids long, ids binary, data binary"
_NAMES = ["bucket", "n", "n_ids", "ids", "data"]


def seeds(own: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Bodies to parcels of packed seeds: those of about PARCEL_SEEDS that fall into a bucket."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], dtype=np.uint64)

    def parcel(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, word, seed, wide = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(seed)
        ids, word, seed, wide = ids[order], word[order], seed[order], wide[order]
        ends = [0, *np.searchsorted(seed, edges).tolist(), len(seed)]
        out = []
        for b, (i, j) in enumerate(zip(ends, ends[1:])):
            if i < j:
                known, place = np.unique(ids[i:j], return_inverse=True)
                step = np.diff(seed[i:j], prepend=np.uint64(0))
                out.append((b, j - i, len(known), packed([np.diff(known, prepend=0)], (8,)), packed([step, place, word[i:j], wide[i:j]], _SEED_WIDTHS)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, texts in opened(batches, 1):
            doc, word, seed, wide = all_seeds(texts, bits)
            if len(seed):
                held.append((batch.column(0).to_numpy(zero_copy_only=False)[doc], word.astype(np.uint32), seed, wide.astype(np.uint32)))
                size += len(seed)
            if size >= PARCEL_SEEDS:
                yield parcel(held)
                held, size = [], 0
        if held:
            yield parcel(held)

    return own.select("doc", "body").mapInArrow(run, _PARCEL)


def partners(seed: np.ndarray, doc: np.ndarray, word: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, word, holder, holder_word, wide) of the places of seeds that an earlier document has: the seed's first place,
    and, with wide = 1, the first with the same MIN_WORDS words where that is another."""
    order = np.argsort(seed, kind="stable")
    alike = seed[order]
    again = np.concatenate(([False], alike[1:] == alike[:-1]))
    order = order[again | np.concatenate((again[1:], [False]))]
    order = order[np.lexsort((word[order], doc[order], seed[order]))]
    seed, doc, word, wide = seed[order], doc[order], word[order], wide[order]
    new = np.concatenate(([True], seed[1:] != seed[:-1]))[: len(seed)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    # A stable sort: within the same MIN_WORDS words the places keep their order.
    within = np.lexsort((wide, seed))
    new = np.concatenate(([True], (seed[within][1:] != seed[within][:-1]) | (wide[within][1:] != wide[within][:-1])))[: len(seed)]
    same = np.empty_like(first)
    same[within] = within[np.flatnonzero(new)[np.cumsum(new) - 1]]
    told = np.flatnonzero(doc != doc[first])
    more = np.flatnonzero((wide > 0) & (same != first) & (doc != doc[same]))
    at, to = np.concatenate((told, more)), np.concatenate((first[told], same[more]))
    return doc[at], word[at], doc[to], word[to], np.repeat(np.array([0, 1], dtype=np.uint32), (len(told), len(more)))


def by_document(doc: np.ndarray, word: np.ndarray, holder: np.ndarray, holder_word: np.ndarray) -> np.ndarray:
    """Order by document, holder, diagonal and word."""
    return np.lexsort((word, word - holder_word, holder, doc))


def matches(own: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Parcels of matches, dealt by document: (doc, word, holder, holder_word, wide) of each seed that an earlier
    document has, as partners() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(parcels(batches), key=lambda r: r[0]):
            parts = []
            for _, n, n_ids, ids, data in group:
                step, place, word, wide = unpacked(data, n, _SEED_WIDTHS)
                known = np.cumsum(unpacked(ids, n_ids, (8,))[0].view(np.int64))
                parts.append((np.cumsum(step, dtype=np.uint64), known[place.view(np.int64)], word.astype(np.uint32), wide.astype(np.uint32)))
            doc, word, holder, holder_word, wide = (x.astype(np.int64) for x in partners(*(np.concatenate(c) for c in zip(*parts))))
            if not len(doc):
                continue
            to = places_of(doc) % buckets
            order = np.lexsort((word, word - holder_word, holder, doc, to))
            to, doc, word, holder, diagonal, wide = to[order], doc[order], word[order], holder[order], (word - holder_word)[order], wide[order]
            ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            out = []
            for i, j in zip(ends, ends[1:]):
                out.append((int(to[i]), j - i, 0, b"", packed([np.diff(doc[i:j], prepend=0), holder[i:j], word[i:j], (diagonal[i:j] << 1) ^ (diagonal[i:j] >> 63), wide[i:j]], _MATCH_WIDTHS)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)

    return seeds(own, buckets, bits).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _PARCEL)


def unpacked_matches(n: int, data: bytes) -> tuple[np.ndarray, ...]:
    """(doc, word, holder, holder_word, wide) of one parcel."""
    step, holder, word, zigzag, wide = (x.view(np.int64) for x in unpacked(data, n, _MATCH_WIDTHS))
    diagonal = (zigzag >> 1) ^ -(zigzag & 1)
    return np.cumsum(step), word, holder, word - diagonal, wide


def copies_of(own: DataFrame) -> DataFrame:
    """(doc, first): the documents of MIN_WORDS words or more whose words an earlier one has as a whole, and the first
    of those."""
    digests = own.filter(F.col("n_words") >= MIN_WORDS).select("doc", "digest")
    # A table of its own: a large group of copies is then joined to it by broadcast or in parts.
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    firsts = written(firsts, "firsts")
    return digests.join(firsts, "digest").filter("doc > first").select("doc", "first").distinct()


def chains(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Collinear chains of (word, holder word) points, each rising on both sides. A point scores SEED_WORDS; the words
    skipped on the way from one to the next cost GAP_COST each, on both sides. Best chains take their points first; a
    chain is cut where a gap exceeds MOST_GAP. A Fenwick tree over the holder's words holds the best (value, index)."""
    points = sorted(points)
    ranks = {y: i + 1 for i, y in enumerate(sorted({y for _, y in points}))}
    size = len(ranks) + 1
    best, holder = [-1e18] * size, [-1] * size
    score, back = [0.0] * len(points), [-1] * len(points)
    waiting: list[tuple[int, float, int]] = []
    column = points[0][0] if points else 0
    for i, (x, y) in enumerate(points):
        if x != column:
            for rank, value, k in waiting:
                while rank < size:
                    if value > best[rank] or value == best[rank] and k > holder[rank]:
                        best[rank], holder[rank] = value, k
                    rank += rank & -rank
            waiting, column = [], x
        own = ranks[y]
        top, j, rank = -1e18, -1, own - 1
        while rank > 0:
            if best[rank] > top or best[rank] == top and holder[rank] > j:
                top, j = best[rank], holder[rank]
            rank -= rank & -rank
        skipped = GAP_COST * (x + y)
        if top > skipped:
            score[i], back[i] = SEED_WORDS + top - skipped, j
        else:
            score[i] = float(SEED_WORDS)
        waiting.append((own, score[i] + skipped, i))
    used = [False] * len(points)
    out = []
    for i in sorted(range(len(points)), key=lambda i: -score[i]):
        chain: list[tuple[int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            x, y = points[i]
            if chain and max(chain[-1][0] - x, chain[-1][1] - y) > MOST_GAP:
                out.append(chain[::-1])
                chain = []
            chain.append((x, y))
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def collected(doc: np.ndarray, word: np.ndarray, holder: np.ndarray, holder_word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, holder, points of the chain, x and y of all points, one chain after another) of the chains of matches. Of a
    run of consecutive seeds every fifth and the last are chained: they cover its words. A pair of documents with one
    run needs no chaining."""
    none = np.zeros(0, dtype=np.int64)
    if not len(doc):
        return none, none, none, none, none
    order = by_document(doc, word, holder, holder_word)
    doc, holder, x, y = doc[order], holder[order], word[order], holder_word[order]
    # Rows that repeat both id and text give the same matches again.
    again = np.concatenate(([False], (doc[1:] == doc[:-1]) & (holder[1:] == holder[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])))
    doc, holder, x, y = doc[~again], holder[~again], x[~again], y[~again]
    pair = np.concatenate(([True], (doc[1:] != doc[:-1]) | (holder[1:] != holder[:-1])))
    run = pair | np.concatenate(([True], (np.diff(x) != 1) | (np.diff(y) != 1)))
    place = np.arange(len(x)) - np.flatnonzero(run)[np.cumsum(run) - 1]
    number = np.cumsum(pair) - 1
    runs = np.bincount(number, run)
    stay = (place % SEED_WORDS == 0) | np.append(run[1:], True)
    doc, holder, x, y, number = doc[stay], holder[stay], x[stay], y[stay], number[stay]
    begins = np.flatnonzero(np.concatenate(([True], np.diff(number) != 0)))
    ends = np.append(begins[1:], len(number))
    single = runs[number[begins]] == 1
    alone = np.repeat(single, ends - begins)
    docs, holders, counts, flat = [], [], [], []
    for i, j in zip(begins[~single].tolist(), ends[~single].tolist()):
        for chain in chains(list(zip(x[i:j].tolist(), y[i:j].tolist()))):
            docs.append(doc[i])
            holders.append(holder[i])
            counts.append(len(chain))
            flat += chain
    more = np.array(flat, dtype=np.int64).reshape(-1, 2)
    first = (doc[begins[single]], holder[begins[single]], (ends - begins)[single], x[alone], y[alone])
    return tuple(np.concatenate((a, np.asarray(b, dtype=np.int64))) for a, b in zip(first, (docs, holders, counts, more[:, 0], more[:, 1])))


def steps_of(counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each point to the next: words on both sides, and whether both are of one chain."""
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(counts) - 1] = False
    return np.diff(x, append=0), np.diff(y, append=0), inner


def certain(doc: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of words that are in a passage whatever stands between the seeds: of whole chains that reach
    SIMILARITY if all words between their seeds differ, and of runs of MIN_WORDS."""
    if not len(doc):
        return doc, doc, doc
    dx, dy, inner = steps_of(counts, x, y)
    apart = (dx >= SEED_WORDS) & (dy >= SEED_WORDS)
    # Seeds that overlap on different diagonals: what alignment() makes of them is bounded by the step and one seed.
    most = np.where(dx == dy, np.maximum(dx - SEED_WORDS, 0), np.where(apart, np.maximum(dx, dy) - SEED_WORDS, np.maximum(dx, dy) + SEED_WORDS))
    ends = np.cumsum(counts)
    begins = ends - counts
    edits = np.add.reduceat(np.where(inner, most, 0), begins)
    size = np.maximum(x[ends - 1] - x[begins], y[ends - 1] - y[begins]) + SEED_WORDS
    good = (size >= MIN_WORDS) & (size - edits >= SIMILARITY * size)
    breaks = ~(inner & (dx == dy) & (dx <= SEED_WORDS))
    last = np.flatnonzero(breaks)
    first = np.concatenate(([0], last[:-1] + 1))
    long = x[last] - x[first] + SEED_WORDS >= MIN_WORDS
    owner = np.repeat(doc, counts)
    columns = ((doc[good], owner[first][long]), (x[begins][good], x[first][long]), (x[ends - 1][good] + SEED_WORDS, x[last][long] + SEED_WORDS))
    return tuple(np.concatenate(c) for c in columns)


def inside(doc: np.ndarray, low: np.ndarray, high: np.ndarray, spans: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether the words from low to high of a document lie within one of the merged spans (doc, start, end)."""
    order = np.lexsort((spans[1], spans[0]))
    owner, start, end = merged(*(c[order] for c in spans))
    if not len(owner):
        return np.zeros(len(doc), dtype=bool)
    known, number = np.unique(owner, return_inverse=True)
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    width = int(max(start.max(), low.max(initial=0))) + 1
    place = np.searchsorted(number * width + start, at * width + low, side="right") - 1
    found = np.maximum(place, 0)
    return (known[at] == doc) & (place >= 0) & (number[found] == at) & (end[found] >= high)


def all_chains(doc: np.ndarray, word: np.ndarray, holder: np.ndarray, holder_word: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """collected() of the matches with first holders, and of those with the first holder of the same MIN_WORDS words
    where these words are not certain to be in a passage already: in a large group of near copies nearly all are."""
    columns = (doc, word, holder, holder_word)
    plain = collected(*(c[wide == 0] for c in columns))
    own = certain(plain[0], *plain[2:])
    left = (wide == 1) & ~inside(doc, word, word + MIN_WORDS, own)
    if not left.any():
        return plain
    # Pairs of documents that gain matches are chained anew.
    key = lambda a, b: mix64(a.astype(np.int64).view(np.uint64)) ^ b.astype(np.int64).view(np.uint64)
    gained = np.unique(key(doc[left], holder[left]))
    again = np.isin(key(doc, holder), gained) & ((wide == 0) | left)
    stay = ~np.isin(key(plain[0], plain[1]), gained)
    points = np.repeat(stay, plain[2])
    kept = (*(c[stay] for c in plain[:3]), *(c[points] for c in plain[3:]))
    return tuple(np.concatenate(c) for c in zip(kept, collected(*(c[again] for c in columns))))


#: Kinds of rows: the chains of a document, the tiles of holders that they need, and parcels: requests for neighbours
#: (dealt by holder), replies, short chains (dealt by document).
CHAINS, TILES, REQUEST, REPLY, SHORT, BODY, JOINT = range(7)
_ROW, _ROW_NAMES = "kind int, bucket long, n long, doc long, holder long, low long, high long, data binary", ["kind", "bucket", "n", "doc", "holder", "low", "high", "data"]
#: Bytes by which requests and replies (steps between holders, words) and short chains (steps between documents,
#: holders, words on both sides, words of the run) are packed.
_ASK_WIDTHS, _SHORT_WIDTHS = (8, 4), (8, 8, 4, 4, 1)


def rows_of(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    whole = {"kind": pa.array(np.full(n, kind, dtype=np.int32))} | {k: v if isinstance(v, pa.Array) else pa.array(v, pa.binary() if k == "data" else pa.int64()) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([whole.get(c, pa.nulls(n, pa.binary() if c == "data" else pa.int64())) for c in _ROW_NAMES], _ROW_NAMES)


def packed_chains(holder: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> bytes:
    """A document's chains: how many, their holders, their points' number, and all points as pairs of 32-bit numbers."""
    return b"".join((np.int64(len(holder)).tobytes(), holder.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), np.column_stack([x, y]).astype("<i4").tobytes()))


def unpacked_chains(data: bytes) -> Iterator[tuple[int, list[list[int]]]]:
    """(holder, points) of packed_chains()."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    holders, counts = (np.frombuffer(data, "<i8", n, at) for at in (8, 8 + 8 * n))
    points = np.frombuffer(data, "<i4", offset=8 + 16 * n).reshape(-1, 2).tolist()
    at = 0
    for holder, count in zip(holders.tolist(), counts.tolist()):
        yield holder, points[at : at + count]
        at += count


def tile_ranges(y: np.ndarray, ye: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last tile of a holder that chains from y to the seed at ye need."""
    return np.maximum(y - reach, 0) // TILE, (ye + SEED_WORDS + reach) // TILE


def chain_rows(doc: np.ndarray, holder: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for the chains of each document, and one for each distinct range of tiles that they need at first."""
    if not len(doc):
        return
    begins = np.cumsum(counts) - counts
    low, high = tile_ranges(y[begins], y[begins + counts - 1], REACH)
    ranges = np.unique(np.column_stack([doc, holder, low, high]), axis=0)
    yield rows_of(TILES, doc=ranges[:, 0], holder=ranges[:, 1], low=ranges[:, 2], high=ranges[:, 3])
    order = np.argsort(doc, kind="stable")
    doc, holder, counts, begins = doc[order], holder[order], counts[order], begins[order]
    point = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    x, y, ends = x[point], y[point], np.concatenate(([0], np.cumsum(counts)))
    edges = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    ids, packs = [], []
    for i, j in zip(edges, edges[1:]):
        a, b = ends[i], ends[j]
        ids.append(int(doc[i]))
        packs.append(packed_chains(holder[i:j], counts[i:j], x[a:b], y[a:b]))
        if len(ids) == 1000 or j == len(doc):
            yield rows_of(CHAINS, doc=ids, data=packs)
            ids, packs = [], []


def divided(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by the bucket that each row goes to, in order of the bucket and the given order within."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    for i, j in zip(edges, edges[1:]):
        if i < j:
            yield int(to[i]), [c[order[i:j]] for c in columns]


def short_rows(bucket: int, buckets: int, doc: np.ndarray, holder: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket's short chains as one parcel, and what they ask of the buckets of their holders, each place once."""
    order = np.argsort(doc, kind="stable")
    columns = [doc[order], holder[order], x[order], y[order], n[order]]
    yield rows_of(SHORT, bucket=[bucket], n=[len(doc)], data=[packed([np.diff(columns[0], prepend=0), *columns[1:]], _SHORT_WIDTHS)])
    places = np.unique(np.column_stack([holder, y]), axis=0)
    asked = list(divided(places_of(places[:, 0]) % buckets, [places[:, 0], places[:, 1]]))
    yield rows_of(REQUEST, bucket=[b for b, _ in asked], n=[len(c[0]) for _, c in asked], doc=[bucket] * len(asked), data=[packed([np.diff(c[0], prepend=0), c[1]], _ASK_WIDTHS) for _, c in asked])


def joint_rows(doc: np.ndarray, holder: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Where the chains of two holders stand side by side in a document, and are not both certain to be passages: a row
    with the holders (the second as `low`) and both chains' points. Another document in which the same two meet may hold
    what each of them holds a part of."""
    if not len(doc):
        return
    ends = np.cumsum(counts)
    begins = ends - counts
    low, high = x[begins], x[ends - 1] + SEED_WORDS
    size = np.flatnonzero(high - low >= JOINT_WORDS)
    size = size[np.lexsort((high[size], low[size], doc[size]))]
    if len(size) < 2:
        return
    a, b = size[:-1], size[1:]
    sure = inside(doc, low, high, certain(doc, counts, x, y))
    side = (doc[a] == doc[b]) & (holder[a] != holder[b]) & (low[b] - high[a] <= MOST_GAP) & (high[b] > high[a]) & ~(sure[a] & sure[b])
    a, b = a[side], b[side]
    for i in range(0, len(a), BATCH_ROWS):
        packs = [packed_chains(np.array([holder[p], holder[q]]), np.array([counts[p], counts[q]]), np.concatenate([x[begins[p] : ends[p]], x[begins[q] : ends[q]]]), np.concatenate([y[begins[p] : ends[p]], y[begins[q] : ends[q]]])) for p, q in zip(a[i : i + BATCH_ROWS].tolist(), b[i : i + BATCH_ROWS].tolist())]
        yield rows_of(JOINT, doc=doc[a[i : i + BATCH_ROWS]], holder=holder[a[i : i + BATCH_ROWS]], low=holder[b[i : i + BATCH_ROWS]], data=packs)


def runs_of(points: list[list[int]]) -> list[tuple[int, int, int]]:
    """(first holder word, words, words of the document ahead of the holder's) of the runs of equal words that a chain's
    points stand for."""
    out: list[list[int]] = []
    for px, py in points:
        if out and px - py == out[-1][2] and py <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], py + SEED_WORDS - out[-1][0])
        else:
            out.append([py, SEED_WORDS, px - py])
    return [tuple(r) for r in out]


def composed(mine: bytes, other: bytes) -> list[tuple[int, int]]:
    """Seeds that two documents share, from what each shares with the same holders: (word, word of the other)."""
    theirs: dict[int, list[tuple[int, int, int]]] = {}
    for holder, points in unpacked_chains(other):
        theirs.setdefault(holder, []).extend(runs_of(points))
    out = set()
    for holder, points in unpacked_chains(mine):
        for y, n, ahead in runs_of(points):
            for y0, n0, ahead0 in theirs.get(holder, ()):
                low, high = max(y, y0), min(y + n, y0 + n0)
                out.update((k + ahead, k + ahead0) for k in range(low, high - SEED_WORDS + 1))
    return sorted(out)


def linked(found: DataFrame) -> DataFrame:
    """Chains, and the tiles that they need, between documents in which the same two holders stand side by side: each
    pair of holders leads to the first document that has it. Pairs in very many documents are counted before they move,
    and meet one row."""
    joints = found.filter(F.col("kind") == JOINT).select("doc", "holder", "low", "data")
    firsts = joints.groupBy("holder", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    heads = written(joints.join(firsts, ["holder", "low"]).filter("doc = first").groupBy("holder", "low").agg(F.first("first").alias("first"), F.min("data").alias("known")), "joints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[], [], [], []]
            for doc, first, mine, other in zip(*(c.to_pylist() for c in batch.columns)):
                for px, py in composed(mine, other):
                    for column, value in zip(columns, (doc, px, first, py)):
                        column.append(value)
            own = np.array(columns, dtype=np.int64)
            if own.size:
                doc, holder, counts, x, y = collected(*own)
                yield from chain_rows(doc, holder, counts, x, y)

    return joints.join(heads, ["holder", "low"]).filter("doc > first").select("doc", "first", "data", "known").mapInArrow(run, _ROW)


def chained(found: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """Parcels of matches and (doc, first) copies to the chains of documents that are no copies, a row for each document,
    but for chains of one run under MIN_WORDS words: these go on as parcels, with requests for what stands beside them
    at their holders. A document has at most two matches a seed, so a bucket of documents is bounded by its text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            out = [(b, len(own), -1, packed([np.diff(own, prepend=0)], (8,)), b"") for b, (own,) in divided(places_of(doc) % buckets, [doc])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in groupby(parcels(batches), key=lambda r: r[0]):
            parts, known = [], [np.zeros(0, np.int64)]
            for _, n, n_ids, ids, data in group:
                if n_ids < 0:
                    known.append(np.cumsum(unpacked(ids, n, (8,))[0].view(np.int64)))
                else:
                    parts.append(unpacked_matches(n, data))
            if not parts:
                continue
            columns = [np.concatenate(c) for c in zip(*parts)]
            own = ~np.isin(columns[0], np.concatenate(known))
            doc, holder, counts, x, y = all_chains(*(c[own] for c in columns))
            if not len(doc):
                continue
            dx, dy, inner = steps_of(counts, x, y)
            ends = np.cumsum(counts)
            words = x[ends - 1] - x[ends - counts] + SEED_WORDS
            broken = np.add.reduceat((inner & ((dx != dy) | (dx > SEED_WORDS))).astype(np.int64), ends - counts) > 0
            short = ~broken & (words < MIN_WORDS)
            points = np.repeat(~short, counts)
            yield from chain_rows(doc[~short], holder[~short], counts[~short], x[points], y[points])
            yield from joint_rows(doc, holder, counts, x, y)
            if short.any():
                first = (ends - counts)[short]
                yield from short_rows(int(bucket), buckets, doc[short], holder[short], x[first], y[first], words[short])

    both = found.unionByName(copies.select("doc").mapInArrow(pack, _PARCEL))
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROW)


def neighbours(word: np.ndarray, first: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place `at` of a text: four bits of a hash of the words from BESIDE before it to 2 * BESIDE after, 0
    outside the text."""
    place = at[:, None] + np.arange(-BESIDE, 2 * BESIDE)
    within = (place >= 0) & (place < (first[text + 1] - first[text])[:, None])
    where = np.where(within, place + first[text][:, None], 0)
    return np.where(within, (word[where] >> np.uint64(40)) % np.uint64(15) + np.uint64(1), np.uint64(0)).astype(np.uint8) if len(word) else np.zeros(place.shape, np.uint8)


def may_grow(own: np.ndarray, beside: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether runs of `n` words can be part of a passage, from neighbours() on both sides. Equal words have equal
    hashes, so a side can only seem to grow further than extend() lets it."""
    rows = np.arange(len(n))
    size, alive = n.astype(np.int64), np.zeros(len(n), dtype=bool)
    for step, start in ((1, BESIDE + n), (-1, np.full(len(n), BESIDE - 1))):
        gain, best, far = (np.zeros(len(n), dtype=np.int64) for _ in range(3))
        going = np.ones(len(n), dtype=bool)
        for k in range(BESIDE):
            a, b = own[rows, start + step * k], beside[rows, start + step * k]
            going &= (a > 0) & (b > 0) & (gain > best - GIVE_UP)
            gain += np.where(going, np.where(a == b, 1, -2), 0)
            far = np.where(going & (gain > 0), k + 1, far)
            best = np.maximum(best, gain)
        size += far
        alive |= going & (gain > best - GIVE_UP)
    return alive | (size >= MIN_WORDS)


def with_bodies(own: DataFrame, parcels_: DataFrame, buckets: int) -> DataFrame:
    """Parcels and bodies of documents in their buckets, the parcels first."""
    rows = own.select(F.lit(BODY).alias("kind"), (F.col("place") % buckets).alias("bucket"), F.lit(0).cast("long").alias("n"), "doc", F.col("body").alias("data"))
    return parcels_.select("kind", "bucket", "n", "doc", "data").unionByName(rows).repartition("bucket").sortWithinPartitions("bucket", "kind")


def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], Iterator[tuple[np.ndarray, list[bytes]]]]]:
    """For each bucket of with_bodies(): its parcels (kind, n, doc, data), and its documents in steps, with their words."""
    grow = zstandard.ZstdDecompressor().decompress

    def documents(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        docs, texts, size = [], [], 0
        for _, _, _, doc, data in rows:
            docs.append(doc)
            texts.append(grow(data))
            size += len(texts[-1])
            if size > STEP_BYTES // 4:
                yield np.array(docs, dtype=np.int64), texts
                docs, texts, size = [], [], 0
        if docs:
            yield np.array(docs, dtype=np.int64), texts

    for bucket, group in groupby(parcels(batches), key=lambda r: r[1]):
        held, first = [], None
        for row in group:
            if row[0] == BODY:
                first = row
                break
            held.append((row[0], row[2], row[3], row[4]))
        yield bucket, held, documents(chain([first], group)) if first else iter(())


def replies(own: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Requests to replies, dealt to the buckets that asked: neighbours() of each place, two to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, documents in bucketed(batches):
            if not held:
                for _ in documents:
                    pass
                continue
            parts = []
            for _, n, back, data in held:
                step, y = (c.view(np.int64) for c in unpacked(data, n, _ASK_WIDTHS))
                parts.append((np.cumsum(step), y, np.full(n, back)))
            holder, y, back = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(holder, kind="stable")
            holder, y, back = holder[order], y[order], back[order]
            for docs, texts in documents:
                docs, kept = np.unique(docs, return_index=True)
                begin, end = np.searchsorted(holder, docs, side="left"), np.searchsorted(holder, docs, side="right")
                if not (end > begin).any():
                    continue
                word, first = word_hashes([texts[i] for i in kept])
                text = np.repeat(np.arange(len(docs)), end - begin)
                place = np.concatenate([np.arange(a, b) for a, b in zip(begin.tolist(), end.tolist())])
                for i in range(0, len(place), BATCH_ROWS):
                    p = place[i : i + BATCH_ROWS]
                    got = neighbours(word, first, text[i : i + BATCH_ROWS], y[p])
                    out = list(divided(back[p], [holder[p], y[p], got[:, 0::2] << 4 | got[:, 1::2]]))
                    data = [packed([np.diff(c[0], prepend=0), c[1]], _ASK_WIDTHS) for _, c in out]
                    yield rows_of(REPLY, bucket=[b for b, _ in out], n=[len(c[0]) for _, c in out], doc=[len(d) for d in data], data=[d + c[2].tobytes() for d, (_, c) in zip(data, out)])

    return with_bodies(own, asked, buckets).mapInArrow(run, _ROW)


def growing(own: DataFrame, shorts: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """The short chains that neighbours do not rule out, in rows like those of chained()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, documents in bucketed(batches):
            asked, known, beside = [], [], []
            for kind, n, size, data in held:
                if kind == SHORT:
                    step, *rest = (c.view(np.int64) for c in unpacked(data, n, _SHORT_WIDTHS))
                    asked.append((np.cumsum(step), *rest))
                else:
                    step, y = (c.view(np.int64) for c in unpacked(data[:size], n, _ASK_WIDTHS))
                    known.append((np.cumsum(step), y))
                    beside.append(np.frombuffer(data[size:], dtype=np.uint8).reshape(n, -1))
            if not known:
                for _ in documents:
                    pass
                continue
            doc, holder, x, y, n = (np.concatenate(c) for c in zip(*asked))
            at_holder, at_y = (np.concatenate(c) for c in zip(*known))
            packs = np.concatenate(beside)
            # Each request has its reply, so the two sorted lists of places are one.
            order = np.lexsort((at_y, at_holder))
            places = np.column_stack([at_holder, at_y])[order]
            _, number = np.unique(np.concatenate([places, np.column_stack([holder, y])]), axis=0, return_inverse=True)
            reply = np.empty(int(number.max()) + 1, dtype=np.int64)
            reply[number.ravel()[: len(places)]] = order
            reply = reply[number.ravel()[len(places) :]]
            for docs, texts in documents:
                docs, kept = np.unique(docs, return_index=True)
                begin, end = np.searchsorted(doc, docs, side="left"), np.searchsorted(doc, docs, side="right")
                if not (end > begin).any():
                    continue
                word, first = word_hashes([texts[i] for i in kept])
                text = np.repeat(np.arange(len(docs)), end - begin)
                place = np.concatenate([np.arange(a, b) for a, b in zip(begin.tolist(), end.tolist())])
                alive = []
                for i in range(0, len(place), BATCH_ROWS):
                    p = place[i : i + BATCH_ROWS]
                    raw = packs[reply[p]]
                    others = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), -1)
                    alive.append(p[may_grow(neighbours(word, first, text[i : i + BATCH_ROWS], x[p]), others, n[p])])
                p = np.concatenate(alive)
                # Seeds that cover a run: every fifth, and the last.
                counts = -(-(n[p] - SEED_WORDS) // SEED_WORDS) + 1
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                shift = np.minimum(inner * SEED_WORDS, np.repeat(n[p] - SEED_WORDS, counts))
                yield from chain_rows(doc[p], holder[p], counts, np.repeat(x[p], counts) + shift, np.repeat(y[p], counts) + shift)

    return with_bodies(own, shorts.unionByName(told), buckets).mapInArrow(run, _ROW)


def tiles_of(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(holder, tile, holder_id, words) of the distinct asked (holder, tile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in opened(batches, 2):
            out = []
            for doc_id, doc, data, tiles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                words = data.split()
                out += [(doc, t, doc_id, b" ".join(words[t * TILE : (t + 1) * TILE])) for t in tiles]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["holder", "tile", "holder_id", "words"])

    # Bounded by the text. A table of its own: where few holders are asked, its size is known and it is broadcast.
    distinct = written(asked.select("holder", "tile").distinct().groupBy("holder").agg(F.collect_list("tile").alias("tiles")), "tiles")
    joined = own.join(distinct, F.col("doc") == F.col("holder")).dropDuplicates(["doc"]).select("doc_id", "doc", "body", "tiles")
    return joined.mapInArrow(run, "holder long, tile long, holder_id long, words binary")


def edits(a: list[bytes], b: list[bytes]) -> int:
    """Words to insert, delete or change: the rows of the table of distances as bits of steps up and down (Myers)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    at: dict[bytes, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, total = full, 0, len(a)
    for y in b:
        equal = at.get(y, 0)
        level = (((equal & up) + up) ^ up) | equal
        rise, fall = (down | ~(level | up)) & full, up & level
        total += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(equal | down | rise)) & full, rise & (equal | down)
    return total


def extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int, known: dict[int, int], most: int | None = None) -> tuple[int, int]:
    """Words by which a match grows on both sides from (i, j): the distance with the most equal words over unequal ones,
    given up GIVE_UP words below the best or, if given, after `most`. Also the place on the side of b where it ended."""
    best = gain = grown = n = 0
    while n != most and 0 <= i < len(a) and j in known and gain > best - GIVE_UP:
        n += 1
        gain += 1 if a[i] == b[known[j]] else -2
        if gain > best:
            best, grown = gain, n
        i, j = i + step, j + step
    return grown, j if 0 <= i < len(a) and gain > best - GIVE_UP else -1


def laid_out(tiles: dict[int, list[bytes]]) -> tuple[list[bytes], dict[int, int]]:
    """The words of the tiles, and where in them each of the holder's words is."""
    other: list[bytes] = []
    place: dict[int, int] = {}
    for t in sorted(tiles):
        for k, w in enumerate(tiles[t]):
            place[t * TILE + k] = len(other)
            other.append(w)
    return other, place


def aligned(words: list[bytes], points: list[tuple[int, int]], tiles: dict[int, list[bytes]], laid: tuple[list[bytes], dict[int, int]] | None = None) -> list[tuple[int, int, int, int, float]] | None:
    """(start, end, holder start, holder end, similarity) of a chain's passages: the longest runs of its seeds that are
    alike to SIMILARITY over MIN_WORDS words or more, none within another, as many as cover what any such run covers.
    None if the chain still grows where the holder's tiles end; a tile beyond the holder's end is empty."""
    other, place = laid or laid_out(tiles)
    span = lambda a, b: other[place[a] : place[a] + b - a] if b > a else []
    # Words on both sides and edits so far, at the start and the end of each seed.
    starts, ends, total = [], [], 0
    at, at0 = points[0]
    for x, y in points:
        # Seeds may overlap, unlike on the two sides: what is left between them is compared.
        to, to0 = max(x, at), max(y, at0)
        total += edits(words[at:to], span(at0, to0))
        starts.append((to, to0, total))
        step = max(0, min(x + SEED_WORDS - to, y + SEED_WORDS - to0))
        same = step if words[to : to + step] == span(to0, to0 + step) else 0
        at, at0 = to + same, to0 + same
        ends.append((at, at0, total))

    outgrown = False

    def grown(x: int, y: int, step: int, most: int | None) -> int:
        nonlocal outgrown
        n, end = extend(words, other, x, y, step, place, most)
        outgrown |= most is None and end >= 0 and end // TILE not in tiles
        return n

    # Inner runs may grow past a stray seed, for MIN_WORDS at least.
    def left(i: int) -> tuple[int, int, int]:
        x, y, done = starts[i]
        n = grown(x - 1, y - 1, -1, max(MIN_WORDS, x - ends[i - 1][0], y - ends[i - 1][1]) if i else None)
        return x - n, y - n, done - edits(words[x - n : x], span(y - n, y))

    def right(j: int) -> tuple[int, int, int]:
        x, y, done = ends[j]
        n = grown(x, y, 1, max(MIN_WORDS, starts[j + 1][0] - x, starts[j + 1][1] - y) if j + 1 < len(points) else None)
        return x + n, y + n, done + edits(words[x : x + n], span(y, y + n))

    # A run of seeds ends at the chain's ends or where edits follow: without any, the longer one is as alike.
    cuts = [i for i in range(1, len(points)) if starts[i][2] > ends[i - 1][2]]
    lefts, rights = np.array([left(i) for i in [0, *cuts]]), np.array([right(i - 1) for i in [*cuts, len(points)]])
    if outgrown:
        return None
    found, furthest = [], -1
    for i, (x, y, done) in enumerate(lefts):
        size = np.maximum(np.maximum(rights[:, 0] - x, rights[:, 1] - y), 1)
        alike = 1 - (rights[:, 2] - done) / size
        good = np.flatnonzero((alike[i:] >= SIMILARITY) & (size[i:] >= MIN_WORDS))
        if len(good) and i + good[-1] > furthest:
            furthest = int(i + good[-1])
            found.append((int(x), int(rights[furthest, 0]), int(y), int(rights[furthest, 1]), float(alike[furthest])))
    out: list[tuple[int, int, int, int, float]] = []
    for n, passage in enumerate(found):
        # One that the next begins before the covered end, and reaches further, adds nothing.
        if not out or n + 1 == len(found) or found[n + 1][0] > out[-1][1]:
            out.append(passage)
    return out


PASSAGES = "array<struct<start:long,end:long,other_id:long,other_start:long,other_end:long,similarity:double>>"


def judged(own: DataFrame, holders: DataFrame, chains_: DataFrame, ranges: DataFrame, reach: int) -> DataFrame:
    """(doc_id, doc, n_words, passages, open, next) of own: the passages of its chains (doc, data), for which the tiles
    in ranges (doc, holder, low, high) hold the `reach` words beyond either end. Chains that outgrow those are left in
    open, and next has the ranges that they need with FURTHER times as many. A chain that lies within a passage of the
    same holder on both sides is another way to align the same words, and adds none."""
    asked = written(ranges.select("doc", "holder", F.explode(F.sequence("low", "high")).alias("tile")).distinct(), "asked")
    # What belongs to one document is bounded by its own seeds.
    sent = asked.join(tiles_of(holders, asked), ["holder", "tile"]).groupBy("doc").agg(F.collect_list(F.struct("holder", "tile", "words", "holder_id")).alias("tiles"))
    listed = chains_.groupBy("doc").agg(F.collect_list("data").alias("chains"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "end", "other_id", "other_start", "other_end"]
        out_type = pa.list_(pa.struct([*((n, pa.int64()) for n in names), ("similarity", pa.float64())]))
        next_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("holder", "low", "high")]))
        for batch, texts in opened(batches, 3):
            out, left, needed = [], [], []
            for data, packs, tiles in zip(texts, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                kept, again, held = [], [], {}
                words = data.split() if packs else []
                for t in tiles or ():
                    held.setdefault(t["holder"], (t["holder_id"], {}))[1][t["tile"]] = t["words"].split()
                by_holder: dict[int, list] = {}
                for pack in packs or ():
                    for holder, points in unpacked_chains(pack):
                        by_holder.setdefault(holder, []).append((-len(points), points))
                for holder, own_chains in by_holder.items():
                    holder_id, own_tiles = held[holder]
                    laid = laid_out(own_tiles)
                    done: list[tuple[int, int, int, int]] = []
                    for _, points in sorted(own_chains):
                        (x, y), (xe, ye) = points[0], (points[-1][0] + SEED_WORDS, points[-1][1] + SEED_WORDS)
                        if any(a <= x and xe <= b and a0 <= y and ye <= b0 for a, b, a0, b0 in done):
                            continue
                        hits = aligned(words, points, own_tiles, laid)
                        if hits is None:
                            again.append((holder, points))
                        for start, end, start0, end0, similarity in hits or ():
                            done.append((start, end, start0, end0))
                            kept.append(dict(zip([*names, "similarity"], (start, end, holder_id, start0, end0, similarity))))
                out.append(kept)
                left.append(None)
                needed.append([])
                if again:
                    holder, counts = (np.array(c, dtype=np.int64) for c in zip(*((h, len(p)) for h, p in again)))
                    points = np.array([q for _, p in again for q in p], dtype=np.int64)
                    begins = np.cumsum(counts) - counts
                    left[-1] = packed_chains(holder, counts, points[:, 0], points[:, 1])
                    low, high = tile_ranges(points[begins, 1], points[begins + counts - 1, 1], reach * FURTHER)
                    needed[-1] = [dict(zip(("holder", "low", "high"), r)) for r in np.unique(np.column_stack([holder, low, high]), axis=0).tolist()]
            columns = [*(batch.column(i) for i in range(3)), pa.array(out, out_type), pa.array(left, pa.binary()), pa.array(needed, next_type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "n_words", "passages", "open", "next"])

    rows = own.join(listed, "doc", "left").join(sent, "doc", "left").select("doc_id", "doc", "n_words", "body", "chains", "tiles")
    return rows.mapInArrow(run, f"doc_id long, doc long, n_words long, passages {PASSAGES}, open binary, next array<struct<holder:long,low:long,high:long>>")


def fuzzy_passages(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words and passages (start and end word, ends exclusive; the holder's doc_id,
    its words, and the similarity), by start.

    Documents are ordered by doc_id as in numbered(). A document whose words an earlier one has as a whole is one
    passage of the first such. Of the others, the first document that has a seed has no passage for it: one copy of
    every passage stays unmarked, and so do repeats of it inside that document, which are out of scope here. MIN_WORDS
    equal words in a later document are always in a passage. Null and short texts have none; rows that repeat id and
    text get the same passages; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    own = written(bodies(numbered(docs)), "bodies")
    n_words = own.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 + n_words // BUCKET_SEEDS
    copies = written(copies_of(own), "copies")
    found = written(chained(matches(own, buckets, hash_bits(n_words)), copies, buckets), "chains")
    told = written(replies(own, found.filter(F.col("kind") == REQUEST), buckets), "replies")
    alive = written(growing(own, found.filter(F.col("kind") == SHORT), told, buckets), "growing")
    removed(spark, told)
    more = written(linked(found), "linked")
    both = found.unionByName(alive).unionByName(more)
    of_kind = lambda kind, *names: both.filter(F.col("kind") == kind).select(*names)
    first = last = written(judged(own, own, of_kind(CHAINS, "doc", "data"), of_kind(TILES, "doc", "holder", "low", "high"), REACH), "passages")
    later, reach = [], REACH
    # Few chains outgrow the words sent: those are judged again with more, until none does.
    while not (left := written(last.filter("open IS NOT NULL").select("doc", F.col("open").alias("data"), "next").dropDuplicates(["doc"]), "open")).isEmpty():
        reach *= FURTHER
        some = own.join(left, "doc", "left_semi").dropDuplicates(["doc"])
        last = written(judged(some, own, left.select("doc", "data"), left.select("doc", F.inline("next")), reach), "passages")
        later.append(last.select("doc", "passages"))
    removed(spark, own, found, alive, more)
    if later:
        again = reduce(DataFrame.unionByName, later).groupBy("doc").agg(F.flatten(F.collect_list("passages")).alias("more"))
        first = first.join(again, "doc", "left").withColumn("passages", F.concat("passages", F.coalesce("more", F.array().cast(PASSAGES))))
    # Ids of the firsts alone, a table of its own: a large group of copies is joined to it by broadcast or in parts.
    names = first.select(F.col("doc").alias("first"), F.col("doc_id").alias("first_id")).dropDuplicates(["first"])
    heads = written(copies.select("first").distinct().join(names, "first"), "heads")
    whole = copies.join(heads, "first").select("doc", "first_id")
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("start"), F.col("n_words").alias("end"), F.col("first_id").alias("other_id"), zero.alias("other_start"), F.col("n_words").alias("other_end"), F.lit(1.0).alias("similarity")))
    first = first.join(whole.withColumn("copied", F.lit(True)), "doc", "left").withColumn("passages", F.when(F.col("copied"), one.cast(PASSAGES)).otherwise(F.col("passages")))
    by_place = F.transform("passages", lambda p: F.struct(p["start"], p["end"], p["other_id"], p["other_start"], p["other_end"], p["similarity"]))
    return first.select("doc_id", "n_words", F.array_sort(by_place).cast(PASSAGES).alias("passages"))


def passages_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_passages, n_dup_words (words inside any passage), other_ids (earlier documents that hold one)."""
    spans = F.transform("passages", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    # Spans come by start: each adds what lies beyond the furthest end so far.
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    grow = lambda acc, p: F.struct((acc["total"] + F.greatest(F.lit(0).cast("long"), p["end"] - F.greatest(p["start"], acc["end"]))).alias("total"), F.greatest(acc["end"], p["end"]).alias("end"))
    return fuzzy_passages(docs).select(
        "doc_id",
        "n_words",
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate(spans, zero, grow)["total"].alias("n_dup_words"),
        F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["other_id"]))).alias("other_ids"),
    )
