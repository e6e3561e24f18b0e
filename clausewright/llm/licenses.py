"""Operator 3, license scans: exact seeds from split notices place candidates, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import steps, text_bytes, texts
from clausewright.llm.words import gaps, padded, plain_spans, plain_words

#: Phrases whose words must stand consecutively (fixed values of the contract).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Notice:
    """words: a notice as plain words. One edit (a byte inserted, deleted or changed) is allowed for every `per_edit`."""

    words: str
    label: str
    per_edit: int = 10

    @property
    def edits(self) -> int:
        return len(self.words) // self.per_edit

    def seeds(self) -> list[tuple[int, str]]:
        """edits + 1 pieces and their offsets: an occurrence within that many edits has one of them unchanged."""
        n = self.edits + 1
        cuts = [len(self.words) * i // n for i in range(n + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


NOTICES = (
    Notice("this work is licensed under the gnu general public license", "gpl"),
    Notice("gnu general public license version 3", "gpl"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("licensed under the apache license version 2 0", "apache"),
    Notice("released under the mit license", "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("licensed under cc by 4 0", "cc-by", 12),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 12),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 12),
    Notice("licensed under cc by nd 4 0", "cc-by-nd", 12),
    Notice("licensed under cc by nc sa 4 0", "cc-by-nc-sa", 12),
    Notice("creative commons attribution", "cc-by"),
    Notice("mozilla public license version 2 0", "mpl"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
)


class NoticeFinder:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.patterns = [regex.compile(b"(?b)(?:" + regex.escape(n.words.encode(), special_only=True) + b"){e<=%d}" % n.edits) for n in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for offset, piece in n.seeds():
                places.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, found in places.items():
            self.seeds.add_word(piece, (len(piece), found))
        self.seeds.make_automaton()

    def candidates(self, joined: bytes) -> set[tuple[int, int, int]]:
        """(notice number, start, end) of ranges of `joined`, one of which holds each occurrence whole. Every range is
        little longer than its notice, so two occurrences apart from each other never share one."""
        ranges = set()
        for end, (length, found) in self.seeds.iter(joined.decode("latin-1")):
            for k, offset in found:
                n = self.notices[k]
                start = end + 1 - length - offset - n.edits
                ranges.add((k, max(0, start), min(len(joined), start + len(n.words) + 2 * n.edits)))
        return ranges

    def find(self, joined: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, notice number, edits) of the best matches in `joined`. Of matches that overlap, the one with the
        smaller share of edits stays, then the longer, then the earlier notice, then the earlier place."""
        found = set()
        for k, a, b in self.candidates(joined):
            if m := self.patterns[k].search(joined, a, b):
                edits = sum(m.fuzzy_counts)
                found.add((edits / len(self.notices[k].words), -len(self.notices[k].words), k, m.start(), m.end(), edits))
        starts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []
        for _, _, k, start, end, edits in sorted(found):
            i = bisect_left(starts, end)
            if not i or kept[i - 1][1] <= start:
                starts.insert(i, start)
                kept.insert(i, (start, end, k, edits))
        return kept


@lru_cache(4)
def finder(notices: tuple[Notice, ...]) -> NoticeFinder:
    return NoticeFinder(notices)


def phrase_starts(joined: bytes, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively."""
    sought, out = b" " + phrase.encode() + b" ", []
    at, counted, words = joined.find(sought), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(sought, at + 1)
    return out


SCHEMA = "doc_id long, n_words long, base array<struct<label:string,word:long>>, notices array<struct<label:string,start:long,end:long,edits:int,score:double>>"


def find_licenses(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (each place of a phrase, by its first word) and notices (verified
    fuzzy spans in code points of the original, ends exclusive, with edits and score = 1 - edits / length).
    A null text is empty; texts of any length are read whole, one step at a time; an empty table gives no rows; repeated
    rows repeat; other columns are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = finder(notices)
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        notice_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))
        for batch in steps(batches):
            counts, base, fuzzy = [], [], []
            for data in text_bytes(batch.column(1)):
                words = plain_words(data)
                joined = padded(words)
                counts.append(len(words))
                base.append([{"label": label, "word": w} for phrase, label in phrases for w in phrase_starts(joined, phrase)])
                fuzzy.append(original_spans(search, data, joined))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(fuzzy, notice_type)], ["doc_id", "n_words", "base", "notices"])

    return texts(docs).mapInArrow(scan, SCHEMA)


def original_spans(search: NoticeFinder, data: bytes, joined: bytes) -> list[dict]:
    found = search.find(joined)
    if not found:
        return []
    spaces = gaps(joined)
    starts, ends = plain_spans(data)
    out = []
    for a, b, k, edits in found:
        # An edit at an edge may take in or leave out a neighbouring space: the span covers the words it touches.
        first = int(np.searchsorted(spaces, a + (joined[a] == 32), side="right")) - 1
        last = max(first, int(np.searchsorted(spaces, b - (joined[b - 1] == 32), side="left")) - 1)
        n = search.notices[k]
        out.append({"label": n.label, "start": int(starts[first]), "end": int(ends[min(last, len(ends) - 1)]), "edits": edits, "score": 1 - edits / len(n.words)})
    return out


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of find_licenses, and spans: the verified notices as label:start:end:edits, by start,
    comma-joined. score: 1 if a base phrase stands in the text, else the best notice's, else 0."""
    label = lambda x: x["label"]
    word = F.transform("base", lambda x: x["word"])
    base, fuzzy = F.transform("base", label), F.transform("notices", label)
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0))
    return find_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, fuzzy)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["label"], *(x[c].cast("string") for c in ("start", "end", "edits")))), ",").alias("spans"),
    )
