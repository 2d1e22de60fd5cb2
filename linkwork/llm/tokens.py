"""Vectorised word splitting, word hashing and window sampling over batches of documents.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All hashes are
functions of content only, so equal words and equal windows hash alike in every task.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True


class Words:
    """Words of several texts: byte spans in ``buf``, hash and index of the owning text."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = SPACE):
        self.buf = b"\n".join(texts) + b"\n" + b"\0" * 8
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        #: first byte of every text, and one past the last text
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(self.buf, dtype=np.uint8)[:-8]
        gap = np.frombuffer(self.buf.translate(breaks.tobytes()), dtype=bool)[:-8]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(data) and not gap[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]
        #: index of the first word of every text, and the number of words
        self.word_at = np.searchsorted(self.start, self.text_at)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        return hash_spans(self.buf, self.start, self.end - self.start, seed)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * MIX[2]
    x = (x ^ (x >> np.uint64(27))) * MIX[3]
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; ``buf`` must go on for 8 bytes after the last one."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    salt = np.uint64(seed * int(MIX[1]) & (2**64 - 1))
    out = mixed((eight[start] & LOW[np.minimum(size, 8)]) + salt + size.astype(np.uint64) * MIX[0])
    at, live = 8, np.flatnonzero(size > 8)
    while len(live):
        part = eight[start[live] + at] & LOW[np.minimum(size[live] - at, 8)]
        out[live] = mixed(out[live] * MIX[0] + part)
        at += 8
        live = live[size[live] > at]
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive hashes (of all texts in a row; see ``inside``)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out + h[j : j + n]) * (MIX[0] + np.uint64(2 * j))
    return mixed(out)


def inside(owner: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` words lie within one text."""
    n = max(0, len(owner) - k + 1)
    return owner[:n] == owner[len(owner) - n :] if n else np.zeros(0, dtype=bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
