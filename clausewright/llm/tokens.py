"""Operator 5, token counts: best unigram segmentations of distinct pre-tokens, scored once per node of a trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from clausewright.llm.common import steps, text_bytes, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for the white space before a pre-token, as in the vocabulary's own pieces.
MARK = "▁"
#: A pre-token's count is kept between batches; the trie starts afresh beyond so many nodes (a bound on memory alone).
TRIE_NODES = 1_000_000
#: Characters of a pre-token beyond which it is scored by itself, outside the trie.
LONG = 1000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with unigram scores. The public file ranks its pieces; a piece of rank r gets log of 1 / (r + 2), Zipf's
    law without its constant. Control and byte pieces are left out: a byte that no piece covers is one token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(usable)}


class Trie:
    """Distinct pre-tokens by shared prefix. Every node holds the score and the number of tokens of the best
    segmentation of its path (ties: fewer tokens), computed once from its ancestors when the node is made."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # A character without a piece falls back to its bytes, at less than any piece's score each.
        self.fallback = min(pieces.values(), default=0.0) - 10.0
        # The pieces read backwards: from the end of a path only what ends some piece is looked at.
        self.backwards: dict = {}
        for piece, value in pieces.items():
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = value
        self.ends: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.ends.clear()

    def best(self, token: str, end: int, scores: list[float], counts: list[int], base: int) -> tuple[float, int]:
        """Score and tokens of token[:end]; scores and counts hold those of its prefixes from token[:base] on."""
        n_bytes = len(token[end - 1].encode())
        top, fewest = scores[end - 1 - base] + n_bytes * self.fallback, counts[end - 1 - base] + n_bytes
        node, at = self.backwards, end - 1
        while at >= 0 and (node := node.get(token[at])) is not None:
            value = node.get("")
            if value is not None:
                total, n = scores[at - base] + value, counts[at - base] + 1
                if total > top or total == top and n < fewest:
                    top, fewest = total, n
            at -= 1
        return top, fewest

    def count(self, token: str) -> int:
        """Tokens of one pre-token, from the node where it ends."""
        if len(token) > LONG:
            return self.count_long(token)
        children, score, tokens = self.children, self.score, self.tokens
        node, scores, counts = 0, [0.0], [0]
        for end, c in enumerate(token, 1):
            below = children[node]
            if below is None:
                below = children[node] = {}
            to = below.get(c)
            if to is None:
                top, fewest = self.best(token, end, scores, counts, 0)
                to = below[c] = len(children)
                children.append(None)
                score.append(top)
                tokens.append(fewest)
            node = to
            scores.append(score[node])
            counts.append(tokens[node])
        return tokens[node]

    def count_long(self, token: str) -> int:
        """The same for a pre-token of any length, of which only as much is held as the longest piece reaches back."""
        scores, counts, base = [0.0], [0], 0
        for end in range(1, len(token) + 1):
            top, fewest = self.best(token, end, scores, counts, base)
            scores.append(top)
            counts.append(fewest)
            if len(scores) > LONG:
                drop = len(scores) - self.longest - 1
                del scores[:drop], counts[:drop]
                base += drop
        return counts[-1]


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_chars (code points) and n_tokens of the whole text.

    Pre-tokens are the runs of anything but ASCII white space, each with MARK before it. The vocabulary is read by the
    driver and broadcast: its size is fixed by the file. The trie is bounded within a text too, and texts and pre-tokens
    of any length are read whole. A null text has no tokens; an empty table gives no rows; repeated rows repeat; other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else load_pieces(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        ends = trie.ends
        for batch in steps(batches):
            words, chars, tokens = [], [], []
            for data in text_bytes(batch.column(1)):
                own = data.split()
                total = 0
                for w in own:
                    n = ends.get(w)
                    if n is None:
                        if len(trie.children) > TRIE_NODES:
                            trie.clear()
                        n = trie.count(MARK + w.decode("utf-8", "replace"))
                        if len(w) <= LONG:
                            ends[w] = n
                    total += n
                words.append(len(own))
                chars.append(len(data.decode("utf-8", "replace")))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, chars, tokens))], ["doc_id", "n_words", "n_chars", "n_tokens"])

    return texts(docs).mapInArrow(count, "doc_id long, n_words long, n_chars long, n_tokens long")
