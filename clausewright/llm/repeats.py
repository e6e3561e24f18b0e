"""Operator 2, suffix-array dedup: bytes inside any 100-byte string that also starts earlier in the corpus go.

Equal strings must meet. Every window of LENGTH bytes has an anchor, the place of its least hashed piece of GRAMS[0]
bytes, and equal windows have equal anchors. The windows around one anchor form a segment. Segments move packed, without
text, to their anchor's bucket. Of equal ones (by 96 bits of XXH3 over their bytes) the first stands for all: the others
start earlier there, and are settled before anything else moves, in part before the exchange. What stands for a class
and shares its anchor with other classes is brought together as text, and a suffix array with the common prefixes of
neighbours shows which of its windows are equal.

An anchor with very many different segments (a frequent line amid ever different text) is divided: its segments are
anchored again by longer pieces, which differ more often, and then go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import RollingHash, joined_bytes, merged, mix64, numbered, removed, steps, text_bytes, written
from clausewright.llm.packing import packed, parcels, unpacked
from clausewright.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
#: Bytes of the pieces that anchor windows, and those that divide hot anchors, one after another. The last are whole
#: windows, of which an anchor has one.
GRAMS = (40, 70, 88, LENGTH)
#: Different segments of one anchor beyond which it is divided.
HOT_SEGMENTS = 256
#: Window starts of one vectorised piece (places take 22 bits), and text bytes of one suffix array.
PIECE, SHARD_BYTES = 2_000_000, 1_000_000
#: Text bytes anchored at once: some 150 bytes of arrays each.
STEP = 500_000
#: Bytes of text whose segments share a bucket, on average; bytes of text whose segments one parcel of a bucket holds.
BUCKET_BYTES, PARCEL_BYTES = 8_000_000, 8_000_000
_PLACE = np.uint64((1 << 22) - 1)


def anchored(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of joined texts: text number, first window's start in the joined array, windows, the hash of the
    anchor's piece, and two hashes (64 and 32 bits) of the whole segment."""
    per_window = LENGTH - gram + 1
    long = np.flatnonzero(lengths >= LENGTH)
    if not len(long):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(len(data) - gram + 1)
    pieces = RollingHash(data).ranges(at, at + gram)
    least = (pieces & ~_PLACE) | at.astype(np.uint64)
    width = 1
    while 2 * width <= per_window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < per_window:
        rest = per_window - width
        least = np.minimum(least[:-rest], least[rest:])
    windows = lengths[long] - LENGTH + 1
    first = np.cumsum(windows) - windows
    doc = np.repeat(long, windows)
    start = np.arange(windows.sum()) - np.repeat(first, windows) + np.repeat(starts[long], windows)
    place = (least[start] & _PLACE).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.concatenate((begins, [len(start)])))
    low, place, doc = start[begins], place[begins], doc[begins]
    raw, digest = memoryview(data.tobytes()), xxhash.xxh3_128_digest
    whole = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(low.tolist(), (low + count - 1 + LENGTH).tolist())]), dtype="<u8").reshape(-1, 2)
    # Least hashes are small numbers: mixed again, they spread over all buckets.
    return doc, low, count, mix64(pieces[place]), whole[:, 0], whole[:, 1] >> np.uint64(32)


def long_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Joined texts of a step, with the offset of the first; one long text alone comes in pieces that share their
    borders' windows."""
    data, starts, lengths = joined_bytes(column, 1)
    if len(data) <= 2 * PIECE:
        yield data, starts, lengths, 0
        return
    for row in range(len(starts)):
        for at in range(0, max(1, int(lengths[row]) - LENGTH + 1), PIECE):
            part = data[starts[row] + at : starts[row] + min(int(lengths[row]), at + PIECE + LENGTH - 1)]
            own_start, own_length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            own_length[row] = len(part)
            yield part, own_start, own_length, at


#: Bytes by which segments are packed: steps between sorted anchors, two hashes, documents (places in a sorted list),
#: first windows' starts, windows. Then places, dealt by document: steps between documents, starts, windows, whether the
#: windows start earlier elsewhere (0), are to be compared (1) or divided (2), and anchors.
_SEGMENT, _PLACES = (8, 8, 4, 4, 4, 2), (8, 4, 2, 1, 8)
_PARCEL, _NAMES = "bucket long, n long, n_ids long, ids binary, data binary", ["bucket", "n", "n_ids", "ids", "data"]
EARLIER, COMPARE, DIVIDE = 0, 1, 2


def document_parcels(doc: np.ndarray, low: np.ndarray, count: np.ndarray, kind: np.ndarray, anchor: np.ndarray, buckets: int) -> list[tuple]:
    """Parcels of places, dealt by document; their buckets follow those of the anchors."""
    to = (mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((low, doc, to))
    to, doc, low, count, kind, anchor = (x[order] for x in (to, doc, low, count, kind, anchor))
    ends = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    return [(int(to[i]) + buckets, j - i, 0, b"", packed([np.diff(doc[i:j], prepend=0), low[i:j], count[i:j], kind[i:j], anchor[i:j]], _PLACES)) for i, j in zip(ends, ends[1:]) if i < j]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _NAMES)


def segments(texts: DataFrame, gram: int, buckets: int, bits: int) -> DataFrame:
    """texts (doc, at, text), at: where in the document the text begins, to parcels of segments, dealt by anchor. A
    segment that equals an earlier one of its parcel starts earlier: it goes to its document's bucket at once."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], dtype=np.uint64)

    def parcel(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, low, count, anchor, one, two = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((low, doc, two, one, anchor))
        doc, low, count, anchor, one, two = (x[order] for x in (doc, low, count, anchor, one, two))
        again = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
        # Rows that repeat both id and text are one document: the same place again is no copy.
        twice = np.concatenate(([False], (doc[1:] == doc[:-1]) & (low[1:] == low[:-1]))) & again
        doc, low, count, anchor, one, two, again = (x[~twice] for x in (doc, low, count, anchor, one, two, again))
        if again.any():
            yield batch_of(document_parcels(doc[again], low[again], count[again], np.zeros(again.sum(), np.int64), np.zeros(again.sum(), np.int64), buckets))
        doc, low, count, anchor, one, two = (x[~again] for x in (doc, low, count, anchor, one, two))
        ends = [0, *np.searchsorted(anchor, edges).tolist(), len(anchor)]
        out = []
        for b, (i, j) in enumerate(zip(ends, ends[1:])):
            if i < j:
                known, place = np.unique(doc[i:j], return_inverse=True)
                out.append((b, j - i, len(known), packed([np.diff(known, prepend=0)], (8,)), packed([np.diff(anchor[i:j], prepend=np.uint64(0)), one[i:j], two[i:j], place, low[i:j], count[i:j]], _SEGMENT)))
        yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in steps(batches, limit=STEP):
            ids, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for data, starts, lengths, offset in long_pieces(batch.column(2)):
                doc, low, count, anchor, one, two = anchored(data, starts, lengths, gram)
                if len(doc):
                    held.append((ids[doc], low - starts[doc] + offset + at[doc], count, anchor >> np.uint64(64 - bits), one, two))
            size += batch.column(2).nbytes
            if held and size >= PARCEL_BYTES:
                yield from parcel(held)
                held, size = [], 0
        if held:
            yield from parcel(held)

    return texts.select("doc", "at", "text").mapInArrow(run, _PARCEL)


def classes(found: DataFrame, buckets: int, most: int) -> DataFrame:
    """Parcels of segments to parcels of places, dealt by document: of each class all but the first are EARLIER; firsts
    whose anchor has several classes are to COMPARE, or to DIVIDE if it has more than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in groupby(parcels(batches), key=lambda r: r[0]):
            if bucket >= buckets:
                for row in group:
                    yield batch_of([row])
                continue
            parts = []
            for _, n, n_ids, ids, data in group:
                step, one, two, place, low, count = unpacked(data, n, _SEGMENT)
                known = np.cumsum(unpacked(ids, n_ids, (8,))[0].view(np.int64))
                parts.append((known[place.view(np.int64)], low.view(np.int64), count.view(np.int64), np.cumsum(step, dtype=np.uint64), one, two))
            doc, low, count, anchor, one, two = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(anchor, kind="stable")
            alike = anchor[order][1:] == anchor[order][:-1]
            order = order[np.concatenate(([False], alike)) | np.concatenate((alike, [False]))]
            if not len(order):
                continue
            order = order[np.lexsort((low[order], doc[order], two[order], one[order], anchor[order]))]
            doc, low, count, anchor, one, two = (x[order] for x in (doc, low, count, anchor, one, two))
            same = (anchor[1:] == anchor[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (doc[1:] == doc[:-1]) & (low[1:] == low[:-1])
            doc, low, count, anchor, one, two = (x[np.concatenate(([True], ~same))] for x in (doc, low, count, anchor, one, two))
            fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            first = fresh | np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            number = np.cumsum(fresh) - 1
            several = np.bincount(number, first)[number]
            kind = np.where(~first, EARLIER, np.where(several > most, DIVIDE, COMPARE))
            needed = ~first | (several > 1)
            if needed.any():
                yield batch_of(document_parcels(*(x[needed] for x in (doc, low, count, kind, anchor.view(np.int64))), buckets))

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _PARCEL)


PLACES = "doc long, ranges array<struct<low:long,high:long>>, asked array<struct<kind:long,anchor:long,low:long,n:long>>, n_hot long"


def by_document(found: DataFrame) -> DataFrame:
    """Parcels of places to one row per document: merged ranges of the EARLIER ones, the others by start, and how many of
    these are to DIVIDE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(parcels(batches), key=lambda r: r[0]):
            parts = []
            for _, n, _, _, data in group:
                step, low, count, kind, anchor = (x.view(np.int64) for x in unpacked(data, n, _PLACES))
                parts.append((np.cumsum(step), low, count, kind, anchor))
            doc, low, count, kind, anchor = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((low, doc))
            doc, low, count, kind, anchor = (x[order] for x in (doc, low, count, kind, anchor))
            ids = np.unique(doc)
            gone = kind == EARLIER
            d, a, b = merged(doc[gone], low[gone], low[gone] + count[gone] - 1 + LENGTH)
            own = ~gone
            asked = listed(ids, doc[own], {"kind": kind[own], "anchor": anchor[own], "low": low[own], "n": count[own]})
            hot = np.bincount(np.searchsorted(ids, doc[kind == DIVIDE]), minlength=len(ids))
            whole = pa.RecordBatch.from_arrays([pa.array(ids), listed(ids, d, {"low": a, "high": b}), asked, pa.array(hot)], ["doc", "ranges", "asked", "n_hot"])
            for i in range(0, len(ids), 2000):
                yield whole.slice(i, 2000)

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PLACES)


def listed(ids: np.ndarray, doc: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    """For each of the sorted ids the rows of its documents, as a list of structs; doc is sorted."""
    inner = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, ids), len(doc)).astype(np.int32)), inner)


def cut_out(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(kind, anchor, doc, low, text) of the places asked for, from texts (doc, at, text) that hold them: each text
    once, with what is asked of its document. A window's place is in one of a document's texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            inner = batch.column(3)
            for row, (doc, at, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)))):
                asked = inner[row].values
                low = asked.field("low").to_numpy(zero_copy_only=False)
                i, j = np.searchsorted(low, [at, at + len(data) - LENGTH + 1]).tolist()
                held = zip(*(asked.field(c)[i:j].to_pylist() for c in ("kind", "anchor", "low", "n")))
                out += [(kind, anchor, doc, a, data[a - at : a - at + n - 1 + LENGTH]) for kind, anchor, a, n in held]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["kind", "anchor", "doc", "low", "text"])

    joined = texts.join(places.filter(F.size("asked") > 0).select("doc", "asked"), "doc").select("doc", "at", "text", "asked")
    return joined.mapInArrow(run, "kind long, anchor long, doc long, low long, text binary")


def repeated_windows(docs: list[int], lows: list[int], parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(doc, low, high) of the bytes covered by windows that also start earlier, from one suffix array of the parts."""
    data = np.frombuffer(b"\xff".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    part_of = np.repeat(np.arange(len(parts)), lengths + 1)[: len(data)]
    start = np.arange(len(data)) - begins[part_of]
    valid = start + LENGTH <= lengths[part_of]
    order = suffix_array(data, LENGTH)
    order = order[valid[order]]
    if not len(order):
        return []
    group = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH)
    doc = np.array(docs, dtype=np.int64)[part_of[order]]
    place = np.array(lows, dtype=np.int64)[part_of[order]] + start[order]
    ranked = np.lexsort((place, doc, group))
    group, doc, place = group[ranked], doc[ranked], place[ranked]
    # The first (doc, place) of a group stays; the same place seen through two parts is still that place.
    fresh = np.concatenate(([True], group[1:] != group[:-1]))
    leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    repeated = (doc != doc[leader]) | (place != place[leader])
    at = np.unique(np.column_stack([doc[repeated], place[repeated]]), axis=0)
    if not len(at):
        return []
    ends = np.flatnonzero((np.diff(at[:, 0]) != 0) | (np.diff(at[:, 1]) != 1))
    first, last = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(at) - 1]))
    return [(int(at[a, 0]), int(at[a, 1]), int(at[b, 1]) + LENGTH) for a, b in zip(first, last)]


def compare_segments(cuts: DataFrame) -> DataFrame:
    """cuts (kind, anchor, doc, low, text) to the ranges (doc, low, high) of windows that start earlier in another of the
    anchor's segments. Anchors stay whole; whole anchors fill shards of SHARD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lows, parts, held, current = [], [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if found := repeated_windows(docs, lows, parts) if len(parts) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc", "low", "high"])

        for batch in batches:
            for anchor, doc, low, text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if anchor != current and held > SHARD_BYTES:
                    yield from flush()
                    docs, lows, parts, held = [], [], [], 0
                current = anchor
                docs.append(doc)
                lows.append(low)
                parts.append(text)
                held += len(text)
        yield from flush()

    return cuts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, low long, high long")


def repeated_ranges(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc, text) of `size` bytes to ranges (doc, low, high) of bytes to remove; ranges may overlap."""
    spark = docs.sparkSession
    out, texts, last = [], docs.select("doc", F.lit(0).cast("long").alias("at"), F.col("text").cast("binary").alias("text")), None
    for gram in GRAMS:
        buckets, bits = 1 + size // BUCKET_BYTES, min(62, (size // 16 + 1).bit_length() + 8)
        most = HOT_SEGMENTS if gram < LENGTH else size
        places = written(by_document(classes(segments(texts, gram, buckets, bits), buckets, most)), "places")
        out.append(places.select("doc", F.explode("ranges").alias("r")).select("doc", "r.low", "r.high"))
        cuts, hot = cut_out(texts, places), not places.filter("n_hot > 0").isEmpty()
        if hot:
            # The texts move once for both; what is divided goes on from its own pieces.
            cuts = written(cuts, "cuts")
        out.append(written(compare_segments(cuts.filter(F.col("kind") == COMPARE)), "compared"))
        if last is not None:
            removed(spark, last)
        if not hot:
            break
        texts, last = cuts.filter(F.col("kind") == DIVIDE).select("doc", F.col("low").alias("at"), "text"), cuts
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    ranges = out[0]
    for more in out[1:]:
        ranges = ranges.unionByName(more)
    return ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (array of the maximal removed runs, start and end in UTF-8 bytes,
    ends exclusive) and kept (the remaining bytes, which can divide a character).

    Documents are ordered by doc_id; rows that share one are ordered by a digest of their text, null ids come first, and
    rows that repeat both id and text are one document. Null and short texts keep everything. An empty table gives no
    rows. Other columns are not read."""
    own = numbered(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = repeated_ranges(own, size).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in steps(batches):
            sizes, spans, kept = [], [], []
            for data, ranges in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                merged: list[list[int]] = []
                for x in sorted((r["low"], r["high"]) for r in ranges or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *(e for x in merged for e in x), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2])) if merged else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = own.join(ranges, "doc", "left").select("doc_id", "doc", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats."""
    return remove_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
