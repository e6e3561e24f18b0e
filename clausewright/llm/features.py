"""Hashed text features in Arrow batches: arrays of feature numbers per document, from whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from clausewright.llm.common import RollingHash, joined_bytes, mix64
from clausewright.llm.words import blank_spans


class Features:
    """Feature numbers of all texts of a step, by family; each family has the document of every number, in order."""

    def __init__(self, column: pa.Array, bits: int):
        self.bits = np.uint64(64 - bits)
        self.data, self.starts, self.lengths = joined_bytes(column, 4)
        self.n = len(self.starts)
        begin, end = blank_spans(self.data)
        self.word_doc = np.searchsorted(self.starts, begin, side="right") - 1
        self.word = RollingHash(self.data).ranges(begin, end)

    def _number(self, hashes: np.ndarray) -> np.ndarray:
        return (mix64(hashes) >> self.bits).astype(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self._number(self.word), self.word_doc

    def word_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Consecutive words of one document. A word that follows itself is the same feature whatever the word."""
        a, b, doc = self.word[:-1], self.word[1:], self.word_doc[1:]
        pair = np.where(a == b, np.uint64(1), a * np.uint64(3) + b)
        same = self.word_doc[:-1] == doc
        return self._number(pair[same]), doc[same]

    def returns(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word that its document had before: how far back, as a power of two (under 64)."""
        order = np.lexsort((np.arange(len(self.word)), self.word, self.word_doc))
        same = (self.word[order][1:] == self.word[order][:-1]) & (self.word_doc[order][1:] == self.word_doc[order][:-1])
        later = order[1:][same]
        distance = later - order[:-1][same]
        at = np.argsort(later, kind="stable")
        return np.log2(distance[at]).astype(np.int64), self.word_doc[later[at]]

    def chars(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of k <= 4 bytes within one document, digits alike."""
        data = np.where((self.data >= 48) & (self.data <= 57), 48, self.data).astype(np.uint32)
        n = max(0, len(data) - k + 1)
        packed = np.zeros(n, dtype=np.uint32)
        for i in range(k):
            packed = packed << np.uint32(8) | data[i : i + n]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        long = self.lengths >= k
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.starts[long] + self.lengths[long] - k + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:n]))
        hashed = (packed[at] * np.uint32(2654435761)) ^ (packed[at] >> np.uint32(15))
        number = (hashed * np.uint32(2246822519)) >> np.uint32(int(self.bits) - 32)
        counts = np.where(long, self.lengths - k + 1, 0)
        return number.astype(np.int64), np.repeat(np.arange(self.n), counts)
