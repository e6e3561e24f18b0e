"""S4 without a model: chunk summaries of the sentences that are central to their chunk.

Sentences are nodes, shared words weigh the edges, and rank flows along them by power iteration, as in Mihalcea and Tarau,
"TextRank: Bringing Order into Texts" (2004). All of it is in whole numbers, so that ranks are the same everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from clausewright.functions import text as T

#: Rank that every sentence has at first and of its own (in thousandths of a thousandth), and what flows of the rest.
START, OWN, FLOWS, ROUNDS = 1_000_000, 150_000, 850, 20
MOST_WORDS = 80
#: Whole numbers below it are exact in double precision.
EXACT = 1 << 53
#: Pairs of sentences whose arrays stand at once.
PAIRS = 1 << 15
_WORD = re.compile(r"[a-z0-9]+")


def word_bits(sentences: list[str]) -> np.ndarray:
    """The distinct words of each sentence of a chunk, as bits in rows of 64-bit numbers."""
    own = [_WORD.findall(s.lower()) for s in sentences]
    words = [w for found in own for w in found]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    held = np.zeros((len(sentences), -(-len(number) // 64) * 64), dtype=bool)
    held[np.repeat(np.arange(len(own)), [len(found) for found in own]), np.array([number[w] for w in words], dtype=np.int64)] = True
    return np.packbits(held, axis=1).view(np.uint64)


def shared_words(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words that each pair of a chunk's sentences shares, and that each sentence has, from the bits (chunk,
    sentence, 64 words). A matrix product would start the threads of a numeric library in every worker."""
    common = np.zeros((*bits.shape[:2], bits.shape[1]), dtype=np.int64)
    for k in range(bits.shape[2]):
        common += np.bitwise_count(bits[:, :, None, k] & bits[:, None, :, k])
    return common, np.bitwise_count(bits).sum(axis=2, dtype=np.int64)


def ranks(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks after ROUNDS rounds. An edge weighs a thousand times what two sentences share, by what they have."""
    weight = 1000 * common // np.maximum(sizes[:, :, None] + sizes[:, None, :], 1)
    weight[:, np.arange(sizes.shape[1]), np.arange(sizes.shape[1])] = 0
    out = np.full(sizes.shape, START, dtype=np.int64)
    degree = np.maximum(1000 * weight.sum(axis=1), 1)
    edges, degrees, flows = weight.astype(np.float64), degree.astype(np.float64)[:, None, :], np.empty(weight.shape)
    heaviest, widest = int(weight.max(initial=0)), int(degree.max(initial=1))
    for _ in range(ROUNDS):
        most = FLOWS * int(out.max(initial=0))
        # Below EXACT no sum is rounded, and no quotient of whole numbers reaches the next whole number by rounding.
        if max(most * heaviest + widest, most * sizes.shape[1]) < EXACT:
            np.multiply(edges, (FLOWS * out).astype(np.float64)[:, None, :], out=flows)
            np.floor(np.divide(flows, degrees, out=flows), out=flows)
            out = OWN + flows.sum(axis=2).astype(np.int64)
        else:
            out = OWN + (FLOWS * out[:, None, :] * weight // degree[:, None, :]).sum(axis=2)
    return out


def unsaid(common: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether a sentence has words and shares half of them, or of the other's, with none of a higher rank (ties: the
    earlier)."""
    place = np.arange(sizes.shape[1])
    higher = (rank[:, None, :] > rank[:, :, None]) | (rank[:, None, :] == rank[:, :, None]) & (place[None, :] < place[:, None])
    alike = 2 * common >= np.minimum(sizes[:, :, None], sizes[:, None, :])
    return (sizes > 0) & ~(higher & alike & (sizes > 0)[:, None, :]).any(axis=2)


def told(sentences: list[str], free: np.ndarray, rank: np.ndarray, most: int) -> str:
    """The summary: by rank as many of the free sentences as have `most` words, one at least, in their order."""
    out, total = [], 0
    for i in np.lexsort((np.arange(len(rank)), -rank)).tolist():
        if free[i]:
            total += len(sentences[i].split())
            if out and total > most:
                break
            out.append(i)
    return " ".join(sentences[i] for i in sorted(out))


def centrals(chunks: list[list[str]], most: int = MOST_WORDS) -> list[tuple[list[int], str]]:
    """Ranks of each chunk's sentences, and its summary in their order. Chunks of about as many sentences go together,
    as one array of so many pairs: a chunk alone costs more in calls than in arithmetic."""
    out: list[tuple[list[int], str]] = [([], "")] * len(chunks)
    order = sorted((i for i, own in enumerate(chunks) if own), key=lambda i: len(chunks[i]))
    while order:
        # The last are the largest; the others of their group are filled up with sentences without words.
        size = len(chunks[order[-1]])
        least = max(size * 7 // 8, 1)
        group = [i for i in order[-max(PAIRS // (size * size), 1) :] if len(chunks[i]) >= least]
        del order[-len(group) :]
        found = [word_bits(chunks[i]) for i in group]
        bits = np.zeros((len(group), size, max(b.shape[1] for b in found)), dtype=np.uint64)
        for at, b in enumerate(found):
            bits[at, : b.shape[0], : b.shape[1]] = b
        common, sizes = shared_words(bits)
        rank = ranks(common, sizes)
        free = unsaid(common, sizes, rank)
        for at, i in enumerate(group):
            n = len(chunks[i])
            out[i] = rank[at, :n].tolist(), told(chunks[i], free[at, :n], rank[at, :n], most)
    return out


def central(sentences: list[str], most: int = MOST_WORDS) -> tuple[list[int], str]:
    """centrals() of one chunk."""
    return centrals([sentences], most)[0]


def central_chunks(chunks: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """chunks (chunk, ...) with sentences, ranks and summary. A chunk has few hundred words, so its graph is small; null
    and empty chunks have no sentences and an empty summary. Nothing leaves its row."""

    @F.pandas_udf("ranks array<long>, summary string")
    def run(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(centrals([list(x) for x in found], most), columns=["ranks", "summary"])

    own = chunks.withColumn("sentences", T.sentences(F.coalesce(F.col("chunk").cast("string"), F.lit(""))))
    return own.withColumn("_found", run("sentences")).select("*", "_found.ranks", "_found.summary").drop("_found")


def central_parts(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """docs (_chunks, ...) with `_parts`, the summaries of their chunks, as summarise() takes them for S4."""
    split = docs.withColumn("_sentences", F.transform("_chunks", T.sentences)).drop("_chunks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = iter(centrals([list(chunk) for row in batch["_sentences"] for chunk in row], most))
            parts = [[next(said)[1] for _ in row] for row in batch["_sentences"]]
            yield batch.drop(columns="_sentences").assign(_parts=parts)

    kept = docs.drop("_chunks").schema
    return split.mapInPandas(run, StructType([*kept, StructField("_parts", ArrayType(StringType()))]))
