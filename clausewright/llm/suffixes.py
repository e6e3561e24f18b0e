"""Suffix arrays by two-stage sorting, and the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last one is larger than the empty suffix)."""
    n = len(data)
    step = np.sign(np.diff(data.astype(np.int16)))
    # Equal neighbours take the answer of the next pair that differs.
    decided = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.zeros(n, dtype=bool)
    known = following < n
    out[:-1][known] = step[following[known]] > 0
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` bytes at least (beyond, ties are in any order).

    Suffixes smaller than their successors are sorted directly. They end their first byte's bucket; one scan from the
    left then puts every other suffix at the head of its bucket as its successor is met."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    small = smaller_than_next(data)
    direct = np.flatnonzero(small)
    room = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(room, depth)[direct]
    direct = direct[np.argsort(keys.reshape(-1).view(f"S{depth}"), kind="stable")] if len(direct) else direct
    counts = np.bincount(data, minlength=256)
    tails = np.cumsum(counts)
    order = np.full(n, -1, dtype=np.int64)
    firsts = data[direct]
    own = np.bincount(firsts, minlength=256)
    order[np.arange(len(direct)) + np.repeat(tails - np.cumsum(own), own)] = direct
    return np.array(induce(order.tolist(), data.tobytes(), small.tobytes(), (tails - counts).tolist()))


def induce(order: list[int], data: bytes, small: bytes, heads: list[int]) -> list[int]:
    last = len(data) - 1
    order[heads[data[last]]] = last
    heads[data[last]] += 1
    for at in order:  # the list grows ahead of the scan
        before = at - 1
        if before >= 0 and not small[before]:
            byte = data[before]
            order[heads[byte]] = before
            heads[byte] += 1
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, block: int = 1 << 15) -> np.ndarray:
    """Length, up to `most`, of the prefix that each suffix of `order` shares with the one before it (first: 0)."""
    room = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most, dtype=np.uint8)]), most)
    out = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), block):
        here, before = order[at : at + block], order[at - 1 : at - 1 + len(order[at : at + block])]
        differ = room[here] != room[before]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        out[at : at + block] = np.minimum(shared, len(data) - np.maximum(here, before))
    return out
