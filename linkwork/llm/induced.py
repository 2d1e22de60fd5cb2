"""External induced sorting of the suffixes of a shard.

Suffixes are classed as L or S by their first difference.  Sorted left-most S suffixes induce the
order of all others through a priority queue: the L suffixes from the smallest character up, the S suffixes
from the largest down.  Characters are bytes, so the queue is one first-in-first-out bucket for each
character; a bucket pops whole batches, and what a batch induces is dealt to the buckets in order.  Buckets beyond
``memory`` bytes go to unnamed files of the task's scratch folder, as do three of the shard's arrays.  The strings
and the other arrays are in memory, some 60 bytes for each byte of the strings, so a shard must fit in its task.

The left-most S suffixes are sorted by recursion: one inducing pass orders the substrings between them, equal
substrings get equal names, and names are joined in pairs, doubling their reach, until they differ or reach over
``depth`` characters.  (Names of pairs are ranked directly; a queue over a large alphabet has no batches
to pop.)  Suffixes are thus in order up to ``depth`` characters, which is all that matching needs.
"""

from __future__ import annotations

import tempfile

import numpy as np

from linkwork.llm.tokens import hash_spans

SEPARATOR = 0


def scratch(n: int, dtype, memory: int) -> np.ndarray:
    """An array in memory, or in an unnamed file if it is large."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.empty(n, dtype=dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype=dtype, shape=(n,), mode="w+")


class Queue:
    """First-in-first-out buckets of positions, one for each character, spilled to disk."""

    def __init__(self, size: int, memory: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]
        self.files: list = [None] * size
        self.memory, self.held = memory, 0

    def push(self, char: int, items: np.ndarray) -> None:
        if not len(items):
            return
        self.parts[char].append(items)
        self.held += items.nbytes
        if self.held > self.memory:
            self.spill()

    def deal(self, chars: np.ndarray, items: np.ndarray) -> None:
        """Push every item to the bucket of its character, in order."""
        if not len(items):
            return
        order = np.argsort(chars, kind="stable")
        chars, items = chars[order], items[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        for char, part in zip(chars[np.append(0, cuts)].tolist(), np.split(items, cuts), strict=True):
            self.push(char, part)

    def spill(self) -> None:
        for char, parts in enumerate(self.parts):
            if parts:
                if self.files[char] is None:
                    self.files[char] = tempfile.TemporaryFile()
                np.concatenate(parts).tofile(self.files[char])
                self.parts[char] = []
        self.held = 0

    def pop(self, char: int) -> np.ndarray:
        """All items of a bucket; it is empty afterwards."""
        parts, self.parts[char] = self.parts[char], []
        self.held -= sum(p.nbytes for p in parts)
        if self.files[char] is not None:
            self.files[char].seek(0)
            parts.insert(0, np.fromfile(self.files[char], dtype=np.int64))
            self.files[char].close()
            self.files[char] = None
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Shard:
    """The strings of a shard, each followed by a separator smaller than every byte."""

    def __init__(self, strings: list[bytes], memory: int = 256 << 20):
        self.memory = memory
        self.buf = b"\0".join(strings) + b"\0" + b"\0" * 8
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.n = int(self.at[-1])
        self.text = scratch(self.n, np.uint16, memory)
        self.text[:] = np.frombuffer(self.buf, dtype=np.uint8)[: self.n]
        self.text += 1
        self.text[self.at[1:] - 1] = SEPARATOR
        self.small = self._types()

    def _types(self) -> np.ndarray:
        """Which suffixes are of type S: smaller than the next one."""
        text = self.text
        rises = np.ones(self.n, dtype=bool)
        rises[:-1] = text[:-1] < text[1:]
        same = np.zeros(self.n, dtype=bool)
        same[:-1] = text[:-1] == text[1:]
        # within a run of one character all suffixes have the type of its last
        decided = np.flatnonzero(~same)
        out = scratch(self.n, bool, self.memory)
        out[:] = np.repeat(rises[decided], np.diff(np.append(-1, decided)))
        return out

    def leftmost(self) -> np.ndarray:
        """S suffixes whose predecessor is of type L, in text order."""
        return np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def induce(self, seeds: np.ndarray):
        """From the left-most S suffixes in order: for each character the L suffixes and, reversed, the S suffixes."""
        text, small, chars = self.text, self.small, 257
        up, seeded = Queue(chars, self.memory), Queue(chars, self.memory)
        larger = Queue(chars, self.memory)
        seeded.deal(text[seeds], seeds)
        for c in range(chars):
            while len(batch := up.pop(c)):
                larger.push(c, batch)
                self._induce(batch, up, False)
            self._induce(seeded.pop(c), up, False)
        down = Queue(chars, self.memory)
        for c in range(chars - 1, -1, -1):
            smaller = []
            while len(batch := down.pop(c)):
                smaller.append(batch)
                self._induce(batch, down, True)
            big = larger.pop(c)
            self._induce(big[::-1], down, True)
            yield c, big, np.concatenate(smaller)[::-1] if smaller else big[:0]

    def _induce(self, batch: np.ndarray, queue: Queue, small: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[self.small[before] == small]
        queue.deal(self.text[before], before)

    def sorted_leftmost(self, depth: int) -> np.ndarray:
        """The left-most S suffixes in order up to ``depth`` characters."""
        first = self.leftmost()
        if len(first) < 2:
            return first
        mark = scratch(self.n, bool, self.memory)
        mark[:] = False
        mark[first] = True
        buckets = []
        for _, _, some in self.induce(first):
            buckets.append(some[mark[some]])
        order = np.concatenate(buckets[::-1])
        # substrings up to and with the next left-most S suffix, named in order
        end = np.append(first[1:], self.n - 1)
        place = np.searchsorted(first, order)
        size = end[place] - order + 1
        digest = hash_spans(self.buf, order, size)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])
        # a separator is not a zero byte
        bounds = 2 * (self.text[order] == SEPARATOR) + (self.text[end[place]] == SEPARATOR)
        new[1:] |= bounds[1:] != bounds[:-1]
        names = np.zeros(len(first), dtype=np.int64)  # the very last suffix is the smallest; nothing induces it
        names[place] = np.cumsum(new)
        reach = 1
        while reach < depth and names.max() < len(order):
            follow = np.zeros_like(names)
            follow[:-reach] = names[reach:]
            if reach >= len(names):
                break
            pair = names * (len(names) + 1) + follow
            _, names = np.unique(pair, return_inverse=True)
            names = names.astype(np.int64) + 1
            reach *= 2
        return first[np.argsort(names, kind="stable")]

    def equal_windows(self, size: int):
        """Yield arrays of positions of whole windows of ``size`` bytes, in order, and which begin a new content."""
        ends = self.at[1:] - 1
        for _, big, some in self.induce(self.sorted_leftmost(size)):
            at = np.concatenate([big, some])
            at = at[at + size <= ends[np.searchsorted(ends, at)]]
            if len(at):
                new = np.ones(len(at), dtype=bool)
                new[1:] = self._common(at[:-1], at[1:], size) < size
                yield at, new

    def _common(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Length of the common prefix of suffixes, 8 bytes at a time, counted up to ``size``."""
        eight = np.ndarray((len(self.buf) - 7,), dtype="<u8", buffer=self.buf, strides=(1,))
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for at in range(0, size, 8):
            differ = eight[a[live] + at] ^ eight[b[live] + at]
            low = differ & (~differ + np.uint64(1))
            step = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
            out[live] += step
            live = live[step == 8]
            if not len(live):
                break
        return np.minimum(out, size)
