"""Benchmark decontamination by SimHash of item-sized windows (operator 6).

Words are lower-cased runs without ASCII punctuation.  A document holds an item if one of its windows
of as many words as the item has a weighted Jaccard similarity of ``threshold`` or more
with the item, over shingles of ``shingle`` words (fewer words: the whole sequence).  A shingle counts as
often as it occurs, times ``1 + log((N + 1) / (f + 1))``, where ``f`` of the ``N`` items have it.

A window can only be similar if it shares a shingle with the item, so windows are formed where a
document has a shingle of an item, and nowhere else.  Each gets a 64-bit SimHash under the same weights.
Item fingerprints are indexed by ``radius + 1`` disjoint bit blocks: a fingerprint within
``radius`` agrees in one block at least, so the index misses none.  Candidates within the radius are verified by
the exact similarity.  At a similarity of 0.8 fingerprints are some 10 bits apart, give or take 3;
the default radius leaves room for that.  A document shorter than an item that it shares a shingle with is one window
as a whole and is verified at once.

Items reach the tasks in blocks of about ``block_bytes`` bytes; a larger benchmark takes several passes
over the documents.  ``f`` counts the items of all blocks: first each text gets the counts of its shingles from every
block, then the blocks compare.  Defined cases: null and empty items match nothing, null and empty texts hold nothing; null
ids are kept as they are; repeated rows are reported alike; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, saved
from linkwork.llm.tokens import Words, grams, inside

BITS = 64
MASK = 2**64 - 1
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCHES = "id long, item_id long, start int, n_words int, similarity double"
_PLACE = np.arange(BITS, dtype=np.uint64)


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_PLAIN)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Hashes of the shingles of each text, in order."""
    words = Words(texts)
    h = words.hashes()
    g = grams(h, k)
    out = []
    for a, b in zip(words.word_at[:-1].tolist(), words.word_at[1:].tolist(), strict=True):
        out.append(g[a : b - k + 1] if b - a >= k else grams(h[a:b], b - a) if b > a else g[:0])
    return out


class Items:
    """Benchmark items: shingle weights, fingerprints and their block index."""

    def __init__(self, rows: list[tuple[int, str, int]], total: int, counts: dict[int, int], k: int, radius: int):
        self.k, self.radius = k, radius
        self.counts, self.total = counts, total
        #: Counts of shingles of the text at hand that only items of other blocks have.
        self.outside: dict[int, int] = {}
        lists = shingles([normal(r[1]) for r in rows], k)
        self.ids = [r[0] for r, s in zip(rows, lists, strict=True) if len(s)]
        self.lists = [s for s in lists if len(s)]
        sizes = [len(w.start) for w in (Words([normal(r[1])]) for r in rows)]
        self.sizes = np.array([n for n, s in zip(sizes, lists, strict=True) if len(s)], dtype=np.int64)
        self.all = np.unique(np.concatenate(self.lists)) if self.lists else np.zeros(0, dtype=np.uint64)
        self.of: dict[int, list[int]] = {}
        for i, s in enumerate(self.lists):
            for x in set(s.tolist()):
                self.of.setdefault(x, []).append(i)
        self.bags = [self.bag(s) for s in self.lists]
        self.sums = [sum(b.values()) for b in self.bags]
        self.prints = np.array([self.fingerprints(s, len(s))[0] for s in self.lists], dtype=np.uint64)
        cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.index: dict[tuple[int, int], set[int]] = {}
        for b, (shift, mask) in enumerate(self.blocks):
            for i, value in enumerate(((self.prints >> shift) & mask).tolist()):
                self.index.setdefault((b, value), set()).add(i)

    def weight(self, shingle: int) -> float:
        return 1 + math.log((self.total + 1) / ((self.counts.get(shingle) or self.outside.get(shingle, 0)) + 1))

    def bag(self, s: np.ndarray) -> dict[int, float]:
        out: dict[int, float] = {}
        for x in s.tolist():
            out[x] = out.get(x, 0.0) + self.weight(x)
        return out

    def fingerprints(self, s: np.ndarray, n: int) -> np.ndarray:
        """SimHash of each run of ``n`` shingles."""
        signs = ((s[:, None] >> _PLACE) & np.uint64(1)).astype(np.float64) * 2 - 1
        signs *= np.array([self.weight(x) for x in s.tolist()])[:, None]
        sums = np.vstack([np.zeros(BITS), np.cumsum(signs, axis=0)])
        ones = sums[n:] - sums[:-n] > 1e-9
        return (ones.astype(np.uint64) << _PLACE).sum(axis=1, dtype=np.uint64)

    def near(self, fingerprint: np.uint64, wanted: set[int]) -> list[int]:
        """Of the items ``wanted`` those whose fingerprint is within the radius."""
        found: set[int] = set()
        for b, (shift, mask) in enumerate(self.blocks):
            found |= self.index.get((b, int((fingerprint >> shift) & mask)), set()) & wanted
            if len(found) == len(wanted):
                break
        return [i for i in found if int(self.prints[i] ^ fingerprint).bit_count() <= self.radius]

    def similarity(self, item: int, window: np.ndarray) -> float:
        return self.likeness(item, self.bag(window))

    def likeness(self, item: int, b: dict[int, float]) -> float:
        a = self.bags[item]
        both = sum(min(w, b.get(x, 0.0)) for x, w in a.items())
        return both / (self.sums[item] + sum(b.values()) - both)

    def matches(self, s: np.ndarray, hits: np.ndarray, words: int, threshold: float) -> list[tuple[int, int, int, float]]:
        """Best window of each item that a text holds; ``hits``: places of shingles that an item has."""
        best: dict[int, tuple[float, int]] = {}
        groups: dict[int, set[int]] = {}
        longer: list[int] = []
        for i in {i for at in hits.tolist() for i in self.of.get(int(s[at]), ())}:
            if self.sizes[i] <= words:
                groups.setdefault(int(self.sizes[i]), set()).add(i)
            else:
                longer.append(i)
        if longer:  # the whole text is the one window; it is compared without a look at fingerprints
            bag = self.bag(s)
            most = sum(bag.values()) * (1 + 1e-9)
            for i in longer:
                if self.sums[i] * threshold <= most and (got := self.likeness(i, bag)) >= threshold - 1e-12:
                    best[i] = (got, 0)
        for size, wanted in groups.items():
            run = max(1, size - self.k + 1)
            starts = (hits[:, None] - np.arange(run)[None, :]).ravel()
            starts = np.unique(starts[(starts >= 0) & (starts + run <= len(s))])
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                if not len(part):
                    continue
                prints = self.fingerprints(s[part[0] : part[-1] + run], run)
                for at, fingerprint in zip(part.tolist(), prints, strict=True):
                    for i in self.near(fingerprint, wanted):
                        got = self.similarity(i, s[at : at + run])
                        if got >= threshold - 1e-12 and (i not in best or (-got, at) < (-best[i][0], best[i][1])):
                            best[i] = (got, at)
        return [(self.ids[i], at, min(int(self.sizes[i]), words), got) for i, (got, at) in sorted(best.items())]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``id_col, item_id, start, n_words, similarity``: for each row and item it holds, the best window."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    total, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(size / block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks)]
    counts = _item_shingles(items, shingle).groupBy("shingle").agg(F.count("*").cast("int").alias("f"))
    if blocks == 1:
        return _block(rows, items, _numbers(counts), total, shingle, threshold, radius).withColumnRenamed("id", id_col)
    counts = saved(counts, "item-shingles")
    of_part = lambda part: _numbers(counts.join(_item_shingles(part, shingle).distinct(), "shingle"))
    rows = _with_counts(rows, [of_part(part) for part in parts], shingle)
    found = [_block(rows, part, of_part(part), total, shingle, threshold, radius) for part in parts]
    return reduce(DataFrame.union, found).withColumnRenamed("id", id_col)


def _item_shingles(items: DataFrame, k: int) -> DataFrame:
    """``shingle``: the distinct shingles of each item."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = shingles([normal(t) for t in batch.column(0).to_pylist()], k)
        return pa.record_batch([pa.array(np.concatenate([np.unique(s) for s in lists]).view(np.int64))], names=["shingle"])

    return arrow_pass(items.select("text"), "shingle long", work)


def _numbers(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and their counts: those of a block at most."""
    got = counts.select("shingle", "f").toArrow()
    keys, f = got.column("shingle").to_numpy().astype(np.int64).view(np.uint64), got.column("f").to_numpy()
    order = np.argsort(keys)
    return keys[order], f[order]


def _with_counts(rows: DataFrame, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``id, text, s, f``: the rows with shingles of any block's items, those shingles and their counts.

    Texts are known by 128 bits of hash.  The blocks pass over the documents one by one, so no task holds the counts
    of more than one; what a text has of them is no longer than the text.
    """
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    found = []
    for keys, f in blocks:

        def work(batch: pa.RecordBatch, keys=keys, f=f) -> pa.RecordBatch | None:
            words = Words([normal(t) for t in batch.column(0).to_pylist()])
            h = words.hashes()
            owners, hits = [], []
            for n in range(1, k + 1):  # short items are shingles of their own size
                g, at = grams(h, n), np.flatnonzero(inside(words.owner, n))
                at = at[np.isin(g[at], keys)]
                owners.append(words.owner[at])
                hits.append(g[at])
            owner, hit = np.concatenate(owners), np.concatenate(hits)
            at = np.unique(owner).tolist()
            if not at:
                return None
            s = [np.unique(hit[owner == i]) for i in at]
            n = [f[np.searchsorted(keys, x)] for x in s]
            s = [x.view(np.int64) for x in s]
            ids = [batch.column(i).take(pa.array(at, pa.int64())) for i in (1, 2)]
            lists = [pa.array(s, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32()))]
            return pa.record_batch([*ids, *lists], names=["a", "b", "s", "f"])

        some = arrow_pass(rows.select("text", "a", "b"), "a long, b long, s array<long>, f array<int>", work)
        found.append(some.dropDuplicates(["a", "b"]))
    lists = [F.flatten(f"all.{name}").alias(name) for name in ("s", "f")]
    known = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.collect_list(F.struct("s", "f")).alias("all")).select("a", "b", *lists)
    return saved(rows.join(known, ["a", "b"]).select("id", "text", "s", "f"), "item-shingle-rows")


def _block(
    rows: DataFrame, items: DataFrame, known: tuple[np.ndarray, np.ndarray], total: int, k: int, threshold: float, radius: int
) -> DataFrame:
    block = [tuple(r) for r in items.collect()]
    made: list[Items] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(Items(block, total, dict(zip(*(x.tolist() for x in known), strict=True)), k, radius))
        items = made[0]
        if not len(items.all):
            return None
        texts = [normal(t) for t in batch.column(1).to_pylist()]
        words = Words(texts)
        h = words.hashes()
        out = []
        for n in sorted({k, *(int(x) for x in items.sizes if x < k)}):  # short items are shingles of their own size
            g = grams(h, n)
            at = np.flatnonzero(inside(words.owner, n))
            at = at[np.isin(g[at], items.all)]
            for owner in np.unique(words.owner[at]).tolist():
                a, b = int(words.word_at[owner]), int(words.word_at[owner + 1])
                hits = at[words.owner[at] == owner] - a
                if n == k:
                    if batch.num_columns > 2:
                        items.outside = dict(zip((x & MASK for x in batch.column(2)[owner].as_py()), batch.column(3)[owner].as_py(), strict=True))
                    out += [(owner, *m) for m in items.matches(g[a : b - n + 1], hits, b - a, threshold)]
                else:
                    seen = {i: p for p in hits[::-1].tolist() for i in items.of[int(g[a + p])] if items.sizes[i] == n}
                    out += [(owner, items.ids[i], p, n, 1.0) for i, p in seen.items()]
        if not out:
            return None
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
        arrays = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
        ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
        return pa.record_batch([ids, *arrays], names=["id", "item_id", "start", "n_words", "similarity"])

    return arrow_pass(rows, MATCHES, work, 512)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, whatever its columns are called, without the rows that hold a benchmark item."""
    name = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    rows = docs.select(name.alias("name"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    bad = contaminated(rows.select("name", "text"), benchmark, "name", "text").select("name").distinct()
    return rows.join(bad, "name", "left_anti").select("row.*")
