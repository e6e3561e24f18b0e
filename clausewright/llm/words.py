"""Word views of texts, on UTF-8 bytes: ASCII separators never occur inside a multi-byte character."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and blanks every other ASCII byte that is not a letter or digit; bytes above 127 stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return data.translate(PLAIN).split()


def padded(words: list[bytes]) -> bytes:
    """The words with one space before, between and after them; without words, one space."""
    return b" " + b" ".join(words) + b" " if words else b" "


def gaps(joined: bytes) -> np.ndarray:
    """Places of the spaces of padded(): the i-th precedes word i."""
    return np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)


def plain_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of plain_words() in the original, in code points."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.frombuffer(data.translate(PLAIN), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edges[0::2]], points[edges[1::2]]


def blank_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are neither ASCII white space nor 0xFF, over joined texts."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)) | (data == 255))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[0::2], edges[1::2]
