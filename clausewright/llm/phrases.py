"""Operator 12, phrase collocation mining: depth-limited count tries per shard, serialised in sorted order, merged by prefix
range; walks down the merged tries give the counts of left parts, suffix links those of right parts."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.common import cut, removed, text_bytes, written

LONGEST, LEAST, KEPT, NO_LANG = 5, 100, 2000, "und"
#: Text bytes of a shard, and leaves of all shards that one prefix range has, more or less.
SHARD_BYTES, RANGE_LEAVES = 8_000_000, 750_000
#: Leaves of a shard's trie that are one row of the table of tries.
ROW_LEAVES = 250_000
#: Nodes of a range that leave it at once.
NODE_ROWS = 20_000
#: Leaves between those that a shard names as a sample, and bytes of their words that are looked at.
SAMPLED, SAMPLE_WORD = 4096, 64
#: Ranges of one dealing: their bounds go to every task. More are made by dealing each range again.
MOST_RANGES = 4096
#: Lower-cases A-Z; ends of pieces become line feeds, tabs blanks.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
WIDTH = 1 + LONGEST


@dataclass
class Words:
    """Byte strings in order, in one Arrow array: a range holds a million words of its tries, which would each be an object."""

    array: pa.LargeBinaryArray

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, i: int) -> bytes:
        return self.array[i].as_py()

    def numbered(self, numbers: np.ndarray) -> pa.LargeBinaryArray:
        """The words of the given numbers, from 1."""
        return self.array.take(pa.array(numbers - 1))


@dataclass
class Trie:
    """A count trie as its leaves in sorted order: a row of word numbers for each (the language, then up to five words,
    0 after the last of a piece), how often it occurs, and the words by number from 1, in byte order."""

    leaves: np.ndarray
    counts: np.ndarray
    words: Words

    def branches(self) -> np.ndarray:
        """For every leaf, the first level on which it leaves the path of the one before; 0 for the first."""
        if not len(self.leaves):
            return np.zeros(0, np.uint8)
        out = np.zeros(len(self.leaves), np.uint8)
        for d in range(WIDTH - 1, -1, -1):
            out[1:][self.leaves[1:, d] != self.leaves[:-1, d]] = d
        return out

    def packed(self) -> tuple[int, bytes]:
        """Level by level: where paths branch off, and the number of each new node; the words that occur, once."""
        # Numbers are marked and counted off, which takes a row a word and no sort of all leaves.
        occurs = np.zeros(len(self.words) + 1, dtype=bool)
        for d in range(WIDTH):
            occurs[self.leaves[:, d]] = True
        own = np.cumsum(occurs, dtype=np.int32) - 1
        used = np.flatnonzero(occurs)
        branches = self.branches()
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        nodes = [small(own[self.leaves[branches <= d, d]]) for d in range(WIDTH)]
        ends = bool(occurs[0])
        data = pickle.dumps((branches, nodes, small(self.counts), ends, self.words.numbered(used[ends:])), protocol=5)
        return len(data), pa.compress(data, codec="zstd", asbytes=True)

    def paths(self, first: int, every: int) -> list[list[bytes]]:
        """The words of each `every`-th leaf from `first` on, cut to what a sample looks at."""
        return [[self.words[i - 1][:SAMPLE_WORD] if i else b"" for i in leaf] for leaf in self.leaves[first::every].tolist()]


def unpacked(size: int, data: bytes) -> Trie:
    branches, nodes, counts, ends, words = pickle.loads(pa.decompress(data, size, codec="zstd", asbytes=True))
    leaves = np.empty((len(branches), WIDTH), dtype=np.int32)
    for d, found in enumerate(nodes):
        leaves[:, d] = found[np.cumsum(branches <= d, dtype=np.int32) - 1]
    leaves += not ends
    return Trie(leaves, counts.astype(np.int64), Words(words))


def sorted_words(words: pa.Array) -> tuple[np.ndarray, Words]:
    """Numbers from 1 of the given words in byte order, and the distinct words."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    return rank[coded.indices.to_numpy()], Words(coded.dictionary.take(pa.array(order)))


def counted(rows: np.ndarray, weights: np.ndarray, words: Words) -> Trie:
    """The trie of rows of word numbers: equal rows are one leaf. Columns are packed into as few keys as hold them."""
    bits = max(1, len(words).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for at in range(0, WIDTH, per):
        key = np.zeros(len(rows), dtype=np.int64)
        for d in range(at, min(at + per, WIDTH)):
            key <<= bits
            key |= rows[:, d]
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(rows), dtype=bool)
    fresh[:1] = True
    for key in keys:
        own = key[order]
        fresh[1:] |= own[1:] != own[:-1]
    first = np.flatnonzero(fresh)
    return Trie(rows[order[first]], np.add.reduceat(weights[order], first) if len(first) else weights[:0], words)


def shard_trie(parts: list[tuple[bytes, bytes]]) -> tuple[Trie, dict[bytes, int]]:
    """The trie of all runs of up to five words within a piece of the given (language, text) parts, as one leaf for each
    word and what follows it, and the number of words of each language."""
    data = np.frombuffer(b"\n".join(text for _, text in parts).translate(PIECES), dtype=np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[0::2].copy(), edges[1::2] - edges[0::2]
    del edges
    n = len(starts)
    langs = sorted({lang for lang, _ in parts})
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    numbers, words = sorted_words(pa.concat_arrays([found, pa.array(langs, pa.large_binary())]))
    del inside, lengths, offsets, found
    of_lang = dict(zip(langs, numbers[n:].tolist()))
    rows = np.zeros((n, WIDTH), dtype=np.int32)
    if n:
        part = np.searchsorted(np.cumsum([len(text) + 1 for _, text in parts]), starts, side="right")
        rows[:, 0] = np.array([of_lang[lang] for lang, _ in parts], dtype=np.int32)[part]
        del part
    piece = np.searchsorted(np.flatnonzero(data == 10), starts).astype(np.int32)
    del data, starts
    for d in range(LONGEST):
        same = piece[d:] == piece[: n - d] if d < n else np.zeros(0, bool)
        rows[: n - d if d < n else 0, 1 + d] = np.where(same, numbers[d:n], 0)
    del piece, numbers, same
    totals = np.bincount(rows[:, 0], minlength=len(words) + 1)
    return counted(rows, np.ones(n, dtype=np.int64), words), {lang: int(totals[k]) for lang, k in of_lang.items()}


def portions(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of `limit` bytes, more or less: cut after a piece; a piece is never divided."""
    at = 0
    while len(text) - at > limit:
        ends = np.flatnonzero(np.frombuffer(text[at : at + limit].translate(PIECES), dtype=np.uint8) == 10)
        upto = limit
        while not len(ends) and at + upto < len(text):  # a piece beyond the limit
            more = np.frombuffer(text[at + upto : at + upto + limit].translate(PIECES), dtype=np.uint8)
            ends, upto = np.flatnonzero(more == 10) + upto, upto + limit
        if not len(ends):
            break
        yield text[at : at + int(ends[-1]) + 1]
        at += int(ends[-1]) + 1
    yield text[at:]


TRIES = "langs map<string,long>, n_leaves long, sample array<array<binary>>, size long, trie binary"


def shard_tries(docs: DataFrame, shard_bytes: int = SHARD_BYTES, sampled: int = SAMPLED) -> DataFrame:
    """docs (lang, text) as rows of TRIES: of each shard its trie, ROW_LEAVES to a row, the first with the words of each
    language. Texts are read whole, long ones in parts cut between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            trie, totals = shard_trie(held)
            held.clear()
            if not len(trie.leaves):
                return
            langs = [(lang.decode(), n) for lang, n in totals.items() if n]
            # A row for some leaves, so that no reader of the table has a whole trie, or several, in one batch.
            for low in range(0, len(trie.leaves), ROW_LEAVES):
                own = Trie(trie.leaves[low : low + ROW_LEAVES], trie.counts[low : low + ROW_LEAVES], trie.words)
                sample = own.paths((sampled // 2 - low) % sampled, sampled)
                whole, data = own.packed()
                yield pa.RecordBatch.from_arrays([pa.array([[] if low else langs], pa.map_(pa.string(), pa.int64())), pa.array([len(own.leaves)], pa.int64()), pa.array([sample], pa.list_(pa.list_(pa.binary()))), pa.array([whole], pa.int64()), pa.array([data], pa.binary())], names=["langs", "n_leaves", "sample", "size", "trie"])

        for batch in batches:
            for lang, text in zip(text_bytes(batch.column(0)), (x.as_py() for x in batch.column(1).cast(pa.large_binary()))):
                for part in portions(text or b"", shard_bytes):
                    held.append((lang, part))
                    size += len(part)
                    if size >= shard_bytes:
                        yield from made()
                        size = 0
        if held:
            yield from made()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, TRIES)


def bounds(trie: Trie, splitters: list[list[bytes]]) -> list[int]:
    """How many leaves stand before each splitter (a path of words); splitters ascend."""
    out, low = [], 0
    for path in splitters:
        # Words of the trie have even places, those between them odd ones.
        places = []
        for word in path:
            i = bisect_left(trie.words, word)
            places.append(0 if not word else 2 * i + 2 if i < len(trie.words) and trie.words[i] == word else 2 * i + 1)
        low = bisect_left(trie.leaves, places, lo=low, key=lambda leaf: (2 * leaf).tolist())
        out.append(low)
    return out


SEGMENTS = "part long, n_leaves long, sample array<array<binary>>, size long, trie binary"


def segments(tries: DataFrame, sampled: int | None = None) -> DataFrame:
    """tries (part, splitters, size, trie) cut at the splitters of their row: SEGMENTS with parts below `part` (part times
    MOST_RANGES and the number of the range). A sample is named if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, splitters, size, data = (c[i].as_py() for c in batch.columns)
                trie, out = unpacked(size, data), []
                cuts = [0, *bounds(trie, splitters), len(trie.leaves)]
                for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    if low < high:
                        own = Trie(trie.leaves[low:high], trie.counts[low:high], trie.words)
                        sample = own.paths(hash((part, k, high)) % sampled, sampled) if sampled else []
                        out.append((part * MOST_RANGES + k, high - low, sample, *own.packed()))
                if out:
                    columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.binary())), pa.int64(), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=["part", "n_leaves", "sample", "size", "trie"])

    return tries.select("part", "splitters", "size", "trie").mapInArrow(run, SEGMENTS)


def splitters_of(samples: DataFrame, n: int) -> list[list[bytes]]:
    """Paths that divide the sampled leaves into at most n ranges of about as many: the sample is dealt by range, and the
    first path of each range comes to the driver."""
    paths = samples.select(F.explode("sample").alias("path")).repartitionByRange(n, "path")
    found = sorted([bytes(w) for w in row["path"]] for row in paths.groupBy(F.spark_partition_id()).agg(F.min("path").alias("path")).collect())
    return found[1:]


NODES = "lang string, phrase string, m int, a long, lefts array<long>, open boolean, n_open int"


def merged(tries: list[Trie]) -> Trie:
    """One trie of many, each in sorted order: words get common numbers, equal leaves add up. Empties the list."""
    numbers, words = sorted_words(pa.concat_arrays([t.words.array for t in tries]))
    rows = np.empty((sum(len(t.leaves) for t in tries), WIDTH), dtype=np.int32)
    counts, at, done = np.concatenate([t.counts for t in tries]), 0, 0
    for t in tries:
        own = np.concatenate((np.zeros(1, np.int32), numbers[at : at + len(t.words)]))
        rows[done : done + len(t.leaves)] = own[t.leaves]
        at, done = at + len(t.words), done + len(t.leaves)
    tries.clear()
    return counted(rows, counts, words)


def frequent_nodes(trie: Trie, least: int) -> Iterator[pa.RecordBatch]:
    """The nodes with `least` occurrences or more, with the counts of the nodes above them, by a walk down the levels;
    and those that the range's ends may divide, whatever their count: they are marked open. Some at a time, as columns:
    where texts repeat, nearly all nodes of a range are frequent."""
    branches = trie.branches()
    number, totals = [], []
    for d in range(WIDTH):
        begin = np.flatnonzero(branches <= d)
        totals.append(np.add.reduceat(trie.counts, begin))
        number.append(np.cumsum(branches <= d, dtype=np.int32) - 1)
        if not d:
            continue
        divided = np.zeros(len(begin), dtype=bool)
        divided[[0, -1]] = True
        kept = np.flatnonzero((trie.leaves[begin, d] > 0) & (divided | (totals[d] >= least)))
        for some in (kept[i : i + NODE_ROWS] for i in range(0, len(kept), NODE_ROWS)):
            at = begin[some]
            above = [number[e][at] for e in range(1, d)]
            n_open = sum((((x == 0) | (x == len(totals[e]) - 1)).astype(np.int32) for e, x in enumerate(above, 1)), np.zeros(len(some), np.int32))
            lefts = np.stack([totals[e][x] for e, x in enumerate(above, 1)], axis=1).ravel() if above else np.zeros(0, np.int64)
            path = [trie.words.numbered(trie.leaves[at, e]) for e in range(d + 1)]
            as_text = lambda c: c.cast(pa.binary()).cast(pa.string())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (d - 1)), pa.array(lefts))
            phrase = pc.binary_join_element_wise(*path[1:], pa.scalar(b" ", pa.large_binary()))
            columns = [as_text(path[0]), as_text(phrase), pa.array(np.full(len(some), d, np.int32)), pa.array(totals[d][some]), listed, pa.array(divided[some]), pa.array(n_open)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NODES.split(", ")])


def merged_ranges(dealt: DataFrame, parts: int, least: int) -> DataFrame:
    """Segments to NODES: each range's tries are merged in one task, one range after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part, size, data = (c[i].as_py() for c in batch.columns)
                if part != current and held:
                    yield from frequent_nodes(merged(held), least)
                current = part
                held.append(unpacked(size, data))
        if held:
            yield from frequent_nodes(merged(held), least)

    moved = dealt.select("part", "size", "trie").repartitionById(parts, F.expr(f"CAST(part % {parts} AS int)"))
    return moved.sortWithinPartitions("part").mapInArrow(run, NODES)


def trie_nodes(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, range_leaves: int = RANGE_LEAVES, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame, bool]:
    """(NODES of all ranges, words of each language, whether the ranges are few). Open nodes come from every range that
    has a part of them."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tries = written(shard_tries(docs, shard_bytes, sampled), "tries")
    total = tries.agg(F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("n")).first()["n"]
    langs = cut(tries.select(F.explode("langs").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")))
    # Ranges as large as is allowed, or as many as there are tasks where that is less.
    ranges = max(1, -(-total // range_leaves), min(parts, total // (4 * sampled)))
    few = ranges <= MOST_RANGES
    found = splitters_of(tries, min(ranges, MOST_RANGES)) if ranges > 1 else []
    kind = "array<array<binary>>"
    first = spark.createDataFrame([(found,)], f"splitters {kind}")
    dealt = segments(tries.select(F.lit(0).cast("long").alias("part"), "size", "trie").crossJoin(F.broadcast(first)), None if few else sampled)
    large = [tries]
    if not few:
        # Every range gets splitters of its own from its own sample, as a row that meets its segments by number.
        dealt = written(dealt, "segments")
        large.append(dealt)
        every = max(1, range_leaves // sampled)
        ordered = dealt.select("part", F.explode("sample").alias("path")).groupBy("part").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        own = ordered.select("part", F.expr(f"transform(sequence({every}, greatest({every}, size(paths) - 1), {every}), i -> paths[i])").alias("splitters"))
        own = own.withColumn("splitters", F.slice(F.filter("splitters", lambda p: p.isNotNull()), 1, MOST_RANGES - 1))
        dealt = segments(dealt.join(own, "part", "left").select("part", F.coalesce("splitters", F.array().cast(kind)).alias("splitters"), "size", "trie"))
    nodes = written(merged_ranges(dealt, parts, least), "nodes")
    removed(spark, *large)
    return nodes, langs, few


def first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def phrase_counts(docs: DataFrame, least: int = LEAST, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a, lefts) of all phrases of one to five words with a >= least: how often they occur, and how
    often their first 1, 2, ... words do; and (lang, n), the words of each language."""
    nodes, langs, few = trie_nodes(docs, least, **sizes)
    # What several ranges share, some ten nodes at each of their bounds, is summed.
    shared = written(nodes.filter("open").groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")), "shared")
    whole = nodes.filter("NOT open").select("lang", "phrase", "m", "a", "lefts", "n_open")
    rows = whole.unionByName(shared.filter(F.col("a") >= least).select("lang", "phrase", "m", "a", F.expr("transform(sequence(1, m), i -> CAST(null AS bigint))").alias("lefts"), (F.col("m") - 1).alias("n_open")))
    for k in range(1, LONGEST):
        above = shared.filter(F.col("m") == k).select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("a").alias(f"_a{k}"))
        met = (F.col("lang") == F.col("_l")) & (first_words(F.col("phrase"), k) == F.col("_p")) & (F.col("m") > k) & (F.col("n_open") >= k)
        rows = rows.join(F.broadcast(above) if few else above, met, "left").drop("_l", "_p")
    lefts = F.array(*(F.coalesce(F.col(f"_a{k}"), F.get("lefts", F.lit(k - 1))) for k in range(1, LONGEST)))
    return rows.select("lang", "phrase", "m", "a", F.slice(lefts, F.lit(1), F.col("m") - 1).alias("lefts")), langs


#: floor(1000 * a * n / (l * r)), exact: products have up to 38 digits.
SCORE = "CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0)) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))"


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, **sizes: int) -> DataFrame:
    """Each language's first `kept` phrases by score: (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of two to five words that occur at least `least` times within pieces of a language's texts
    (overlaps count). A phrase's score is that of its weakest cut into l * r, floor(1000 * a * n / (l * r)), the earliest
    of equal ones; phrases that a longer one accounts for (as many occurrences) go. Null languages are `und`; null and
    empty texts have no words; texts of any length are read whole; repeated rows count; an empty table gives no rows;
    ties are ordered by phrase; other columns are not read.

    A shard's trie holds what repeats within it once, and ranges of prefixes are cut where a sample says that leaves are
    many, to the full depth, so neither a hot word nor a hot phrase is one task's. sizes: as for trie_nodes(); a larger
    corpus wants larger shards."""
    counts, langs = phrase_counts(docs, least, **sizes)
    counts = written(counts, "phrases")
    candidates = counts.filter("m > 1")
    cuts = candidates.select("lang", "phrase", "m", "a", F.posexplode("lefts").alias("k", "l")).withColumn("k", F.col("k") + 1)
    # A suffix link drops the first word: k of them lead to what is right of the cut.
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', k - m)"))
    ends = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("a").alias("r"))
    linked = cuts.join(ends, (F.col("lang") == F.col("_l")) & (F.col("rest") == F.col("_p"))).join(langs, "lang")
    whole = linked.select("lang", "phrase", "a", "n", F.struct(F.expr(SCORE).alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    # A longer phrase with the same count holds one that is a word longer and has it too.
    parts = candidates.filter("m > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase"), F.col("a").alias("longer"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema if f.name not in parts.columns}
    rows = whole.unionByName(parts.select("*", *empty.values())).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    live = rows.filter("longer IS NULL OR longer < a").select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # Within slices of a language first, so that its phrases never meet in one task.
    first = live.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", best("lang", "_slice")).filter(F.col("rank") <= kept)
    ranked = first.withColumn("rank", best("lang")).filter(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASES_SQL = rf"""
WITH w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) AS a),
n AS (SELECT lang, sum(len(l))::BIGINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, unnest(list_transform(range(1, len(l) - m + 2), lambda i: array_to_string(l[i:i + m - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) AS x(m) WHERE len(l) >= m) AS a GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, a, k, array_to_string(p[1:k], ' ') AS f, array_to_string(p[k + 1:], ' ') AS s FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, m)) AS k FROM g WHERE m > 1) AS b),
e AS (SELECT c.lang, c.phrase, c.a, n, k, x.a AS l, y.a AS r, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score FROM c JOIN n ON c.lang = n.lang JOIN g AS x ON c.lang = x.lang AND c.f = x.phrase JOIN g AS y ON c.lang = y.lang AND c.s = y.phrase),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT g.lang, array_to_string(p[i:i + k - 1], ' ') AS phrase, g.a FROM (SELECT *, string_split(phrase, ' ') AS p FROM g WHERE m > 2) AS g, range(2, {LONGEST}) AS x(k), range(1, {LONGEST}) AS y(i) WHERE k < m AND i + k - 1 <= m)
SELECT lang, row_number() OVER q AS rank, phrase, a, l, r, n, score FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.a >= 100 * b.a)
WINDOW q AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER q <= {KEPT}
"""
