"""Removal of repeated lines by an exact set-similarity join (operator 2).

A line is the set of its words, and its place is (id, line number, text hash).  A line goes if a line of an earlier
place has the same words or a Jaccard similarity of ``threshold`` or more, judged on the input.  Lines of equal sets form one class, of
which only the first place counts; classes are joined as follows.

1. Count words over the whole corpus in a sketch of fixed size, in the pass that finds the classes; it is
   small enough to broadcast (``SKETCH`` counters).  Order the words of a line by
   that count, rarest first, ties by hash: one order for all lines.
2. Two lines as similar as ``threshold`` share a word of their prefixes, the first
   ``n - ceil(threshold * n) + 1`` words.  Postings of the prefix words of each class's first line are dealt by
   word.  Within a word they are sorted by size and joined under the length filter, the positional
   filter (the words after the shared one have to make up the needed overlap) and a bitmap bound on the symmetric
   difference.
3. A line needs one earlier partner.  So a word returns each line's ``FIRST`` earliest candidates; their
   words travel to the line's text, where the Jaccard similarity is verified.  A family of near copies thus costs
   a few rows for each member, not one for each pair.
4. Lines with further candidates that have found no partner so are joined again, with all of their
   candidates; lines without a word of theirs are not read, by a bitmap of fixed size, which drops such postings too.

The lines that are the first of their class are joined to the texts as these are dealt (``numbers``), so later passes
read texts and line numbers together, in place.  A text is known by its id and, under an id that several texts share, its hash (else 0), so null and repeated ids are
spread like the others.  Postings travel packed by columns, one array for each task batch and word bucket.  Blank lines are neither
matched nor removed.  Defined cases: a null text has no lines; a null id is the smallest; rows that share an id, or
have none, are told apart by the hash of their texts, and rows equal in both lose the same lines; an empty table
gives no rows; further columns are kept by ``distinct_line_texts`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, dealt, id_of, key_of, partitions, released, saved, small_batches, unpacked, utf8
from linkwork.llm.sampling import flat
from linkwork.llm.tokens import MIX, Words, hash_spans, mixed

#: Counters of the word sketch, and pieces in which they are summed.
SKETCH, PIECES = 1 << 20, 32
#: Pairs that a task looks at in one go; each takes some 90 bytes meanwhile.
PAIRS = 1 << 18
#: Bits of the bitmap of open lines' words, and of a piece of it (Spark's bitmap functions fix that).
BITMAP, PIECE = 1 << 23, 1 << 15
#: Earliest candidates of a line that are verified first.
FIRST = 2
#: ``low`` and ``high``: a bitmap of 128 bits, the parity of the line's words by hash
POSTING = np.dtype([("word", "<u4"), ("key", "<i8"), ("number", "<u4"), ("low", "<u8"), ("high", "<u8"), ("n", "<u4"), ("at", "<u4")])
#: With the hash of the text, for batches with shared ids.
SHARED = np.dtype([*POSTING.descr, ("th", "<i8")])
EPS = 1e-9


class Lines:
    """The word sets of the lines of several texts; ``rarity`` orders words within a line, ``counts`` takes their numbers.

    ``only``: a list column, one list for each text, of the lines to be read, if not all are.
    ``having``: a bitmap of words; lines without any of them are not read.
    """

    def __init__(
        self,
        texts: list[bytes],
        rarity: np.ndarray | None = None,
        counts: np.ndarray | None = None,
        only: pa.ListArray | None = None,
        having: np.ndarray | None = None,
    ):
        words = Words(texts)
        breaks = np.flatnonzero(np.frombuffer(words.buf, dtype=np.uint8)[:-8] == 10)
        line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(words.start, breaks), prepend=0))
        start, size = words.start, words.end - words.start
        if only is not None:
            keep = _named_lines(only, breaks, words.text_at)[line]
            start, size, line = start[keep], size[keep], line[keep]
        h = hash_spans(words.buf, start, size)
        if counts is not None:
            counts += np.bincount(slots(h), minlength=SKETCH)
        if having is not None:
            some = np.zeros(len(breaks), dtype=bool)
            some[line[having[_bit(h)]]] = True
            keep = some[line]
            h, line = h[keep], line[keep]
        # words stand by line already, so the order moves them within their lines
        h = h[_line_order(line, h, None if rarity is None else rarity[slots(h)])]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.words, line = h[new], line[new]
        head = np.ones(len(line), dtype=bool)
        head[1:] = line[1:] != line[:-1]
        #: first word of each line that has words, the number of its words, its text and its place there
        self.first = np.flatnonzero(head)
        self.n = np.diff(np.append(self.first, len(line)))
        at = line[self.first]
        self.text = np.searchsorted(words.text_at, breaks[at], side="right") - 1 if len(at) else at
        self.number = at - np.searchsorted(breaks, words.text_at[self.text])

    def classes(self) -> np.ndarray:
        """A hash of the set of words of each line."""
        total = np.add.reduceat(mixed(self.words + MIX[1]), self.first) if len(self.first) else self.words
        return mixed(total ^ (self.n.astype(np.uint64) * MIX[0])).view(np.int64)

    def prefix(self, threshold: float) -> np.ndarray:
        """Words of each line's prefix."""
        return self.n - np.ceil(threshold * self.n - EPS).astype(np.int64) + 1


def _named_lines(numbers: pa.ListArray, breaks: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Which lines, each ended by one of ``breaks``, a list column, one list for each text, names."""
    wanted, row = flat(numbers)
    first = np.searchsorted(breaks, text_at)
    out = np.zeros(len(breaks), dtype=bool)
    out[(first[row] + wanted)[wanted < first[row + 1] - first[row]]] = True
    return out


def _line_order(line: np.ndarray, h: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Order by line, rank and hash; one packed sort key unless two words of a line agree in it."""
    packed = (line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(32))
    if rank is not None:
        packed |= rank.astype(np.uint64) << np.uint64(32)
    order = np.argsort(packed)
    packed = packed[order]
    tied = np.flatnonzero(packed[1:] == packed[:-1])
    if (h[order[tied]] != h[order[tied + 1]]).any():
        return np.lexsort((h, line) if rank is None else (h, rank, line))
    return order


def slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int64)


def _scanned(rows: DataFrame) -> DataFrame:
    """One pass over ``key, th, text``: ``cls, key, number, th`` of each line with words, and each task's word counts.

    Counts are rows of ``part, counts``, the other columns null there.
    """
    names = ["cls", "key", "number", "th", "part", "counts"]

    def run(batches):
        sums = np.zeros(SKETCH, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lines = Lines(utf8(batch.column(2)), counts=sums)
                keys, th = (batch.column(i).to_numpy(zero_copy_only=False)[lines.text] for i in (0, 1))
                columns = [pa.array(lines.classes()), pa.array(keys), pa.array(lines.number.astype(np.int32)), pa.array(th)]
                none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())]
                yield pa.record_batch([*columns, *none], names=names)
        parts = [p.astype("<u4").tobytes() for p in sums.reshape(PIECES, -1)]
        none = [pa.nulls(PIECES, kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.record_batch([*none, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return rows.mapInArrow(run, "cls long, key long, number int, th long, part int, counts binary")


def rarity(counted: DataFrame) -> np.ndarray:
    """Logarithmic word counts from rows of ``part, counts``, by slot: one byte for each of ``SKETCH`` counters."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        logs = [np.round(np.log2(s + 1) * 4).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["part", "logs"])

    dealt = counted.where("part is not null").select("part", "counts").repartition(PIECES, "part")
    out = np.zeros((PIECES, SKETCH // PIECES), dtype=np.uint8)
    for part, logs in dealt.mapInArrow(add, "part int, logs binary").collect():  # fixed size: SKETCH bytes
        out[part] = np.frombuffer(logs, dtype=np.uint8)
    return out.reshape(-1)


def _postings(rows: DataFrame, ranks, threshold: float, buckets: int, words=None) -> DataFrame:
    """``bucket, data``: packed postings of the prefix words of the lines ``numbers``.

    ``words``: a bitmap of word slots; postings of other words are left out.
    """
    least = int(np.floor(1 / (1 / threshold - 1) + EPS)) if threshold < 1 else 2**31

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        wanted = None
        if words is not None:
            wanted = np.unpackbits(np.frombuffer(words.value, dtype=np.uint8), bitorder="little").view(bool)
        rank = np.frombuffer(ranks.value, dtype=np.uint8)
        lines = Lines(unpacked(batch.column(2)), rank, only=batch.column(3), having=wanted)
        prefix = np.where(lines.n >= least, lines.prefix(threshold), 0)
        line = np.repeat(np.arange(len(prefix)), prefix)
        at = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        word = lines.words[lines.first[line] + at]
        if wanted is not None:
            has = wanted[_bit(word)]
            line, at, word = line[has], at[has], word[has]
        if not len(line):
            return None
        bucket = mixed(word) % np.uint64(buckets)
        place = (bucket << np.uint64(32)) | (word >> np.uint64(32))
        order = np.argsort(place)
        place, line, at = place[order], line[order], at[order]
        spread = mixed(lines.words ^ MIX[0])
        bit = np.uint64(1) << (spread & np.uint64(63))
        upper = (spread >> np.uint64(6)) & np.uint64(1)
        keys, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        columns = {
            "word": place & np.uint64(2**32 - 1),
            "key": keys[lines.text][line],
            "number": lines.number[line],
            "low": np.bitwise_xor.reduceat(bit * (np.uint64(1) - upper), lines.first)[line],
            "high": np.bitwise_xor.reduceat(bit * upper, lines.first)[line],
            "n": lines.n[line],
            "at": at,
        }
        kind = POSTING
        if th.any():
            kind, columns["th"] = SHARED, th[lines.text][line]
        bucket = (place >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = _packed(columns, kind, first)
        return pa.record_batch([pa.array(bucket[first]), pa.array(parts, pa.binary())], names=["bucket", "data"])

    return arrow_pass(rows.select("key", "th", "data", "numbers"), "bucket int, data binary", work, 1024)


def _packed(columns: dict[str, np.ndarray], kind: np.dtype, first: np.ndarray) -> list[bytes]:
    """Postings from each ``first`` to the next, by byte columns, compressed; the first byte is the size of one."""
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    size = len(columns["word"])
    table = np.empty((kind.itemsize, size), dtype=np.uint8)
    for name, (of, at) in kind.fields.items():
        table[at : at + of.itemsize] = columns[name].astype(of).view(np.uint8).reshape(size, -1).T
    ends = np.append(first[1:], size)
    parts = (np.ascontiguousarray(table[:, a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True))
    return [bytes([kind.itemsize]) + pack(part) for part in parts]


def _postings_of(data: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    kind = POSTING if data[0] == POSTING.itemsize else SHARED
    columns = np.frombuffer(unpack.decompress(data[1:]), dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(columns.T).view(kind).reshape(-1)


def _together(parts: list[np.ndarray]) -> np.ndarray:
    """All postings in one array, with hashes if any part has them."""
    if len({p.dtype.itemsize for p in parts}) == 1:
        return np.concatenate([p.view(np.uint8) for p in parts]).view(parts[0].dtype)
    out = np.zeros(sum(map(len, parts)), dtype=SHARED)
    at = 0
    for p in parts:
        for name in p.dtype.names:
            out[name][at : at + len(p)] = p[name]
        at += len(p)
    return out


def _hash(p: np.ndarray) -> np.ndarray:
    return p["th"] if p.dtype == SHARED else np.zeros(len(p), dtype=np.int64)


def _by_size(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number that orders postings by word and size."""
    return (word.astype(np.uint64) << np.uint64(32)) | n


def _longest(n: np.ndarray, threshold: float) -> np.ndarray:
    """Size of the longest line that can be as similar as ``threshold`` to one of ``n`` words."""
    return np.floor(n / threshold + EPS).astype(np.uint64)


def _with_partners(p: np.ndarray, threshold: float) -> np.ndarray:
    """Of postings sorted by word and size those that share a word with one of a fitting size."""
    near = _by_size(p["word"][1:], p["n"][1:]) <= _by_size(p["word"][:-1], _longest(p["n"][:-1], threshold))
    keep = np.zeros(len(p), dtype=bool)
    keep[1:] = near
    keep[:-1] |= near
    return p[keep]


def _line_numbers(p: np.ndarray) -> np.ndarray:
    """For each posting the number of its line, lines counted by place."""
    if not len(p):
        return np.zeros(0, dtype=np.int64)
    key, number = p["key"], p["number"]
    low, bits = int(key.min()), int(number.max()).bit_length()
    if p.dtype == POSTING and (int(key.max()) - low).bit_length() + bits <= 64:
        place = [((key - low).astype(np.uint64) << np.uint64(bits)) | number]
        order = np.argsort(place[0])
    else:
        place = [key, number, _hash(p)]
        order = np.lexsort(place[::-1])
    new = np.ones(len(p), dtype=bool)
    new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in place])
    line = np.empty(len(p), dtype=np.int64)
    line[order] = np.cumsum(new)
    return line


def candidates(p: np.ndarray, age: np.ndarray, threshold: float):
    """Yield index pairs (earlier, later) of the postings of some words, sorted by word and size, that pass the filters.

    ``age`` numbers lines by place.
    """
    stop = np.searchsorted(_by_size(p["word"], p["n"]), _by_size(p["word"], _longest(p["n"], threshold)), side="right")
    partners = stop - np.arange(len(p)) - 1
    ends = np.cumsum(partners)
    begin = 0
    while begin < len(p):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        for a, b in _pairs(partners, begin, end):
            n, m = p["n"][a].astype(np.int64), p["n"][b].astype(np.int64)
            need = np.ceil(threshold / (1 + threshold) * (n + m) - EPS)
            # the shared word and the words after it
            ok = np.minimum(n - p["at"][a], m - p["at"][b]) >= need
            a, b, spare = a[ok], b[ok], (n + m - 2 * need)[ok]
            differ = np.bitwise_count(p["low"][a] ^ p["low"][b]) + np.bitwise_count(p["high"][a] ^ p["high"][b])
            ok = differ <= spare
            a, b = a[ok], b[ok]
            less = age[a] < age[b]
            x, y = np.where(less, a, b), np.where(less, b, a)
            other = age[a] != age[b]  # rows equal in id and text
            if len(x):
                yield x[other], y[other]
        begin = end


def _pairs(partners: np.ndarray, begin: int, end: int):
    """Index pairs of the postings from ``begin`` to ``end`` with their partners, in bounded pieces."""
    if end - begin == 1:
        for at in range(0, int(partners[begin]), PAIRS):
            b = begin + 1 + np.arange(at, min(at + PAIRS, int(partners[begin])))
            yield np.full(len(b), begin), b
        return
    counts = partners[begin:end]
    a = np.repeat(np.arange(begin, end), counts)
    if len(a):
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)


def _earliest(x: np.ndarray, y: np.ndarray, age: np.ndarray, line: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each later line its ``most`` earliest distinct partners."""
    order = np.lexsort((age[x], line[y]))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (line[y[1:]] != line[y[:-1]]) | (line[x[1:]] != line[x[:-1]])
    x, y = x[new], y[new]
    head = np.ones(len(x), dtype=bool)
    head[1:] = line[y[1:]] != line[y[:-1]]
    first = np.flatnonzero(head)
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x[rank < most], y[rank < most]


def _join(postings: DataFrame, threshold: float, most: int | None, only: DataFrame | None = None) -> DataFrame:
    """``key, number, th, xkey, xnumber, xth``: later lines and earlier candidates, the ``most`` earliest of a task.

    ``only``: ``bucket, data`` rows with postings of the later lines to be joined, if not all are.
    """

    restricted = only is not None

    def run(batches):
        parts, wanted, unpack = [], [], zstandard.ZstdDecompressor()
        for batch in batches:
            for data, late in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (wanted if late else parts).append(_postings_of(data, unpack))
        if not parts:
            return
        p = _together(parts)
        p = _with_partners(p[np.argsort(_by_size(p["word"], p["n"]))], threshold)
        # numbers lines by place
        line = _line_numbers(p)
        late = None
        if wanted:
            w = _together(wanted)
            late = np.isin(_places(p), np.unique(_places(w)))
        elif restricted:
            return
        have, new, bound = [(np.zeros(0, np.int64),) * 2], 0, PAIRS
        for x, y in candidates(p, line, threshold):
            if late is not None:
                x, y = x[late[y]], y[late[y]]
            have.append((x, y))
            new += len(x)
            if new > bound:
                have, new = [_earliest(*map(np.concatenate, zip(*have, strict=True)), line, line, most or len(p))], 0
                if most is None:
                    yield _found(p, *have.pop())
                else:  # what is kept is sorted again only when as much has come
                    bound = max(PAIRS, len(have[0][0]))
        if have:
            yield _found(p, *_earliest(*map(np.concatenate, zip(*have, strict=True)), line, line, most or len(p)))

    n = partitions(postings.sparkSession)
    rows = postings.withColumn("late", F.lit(False))
    if only is not None:
        rows = rows.union(only.withColumn("late", F.lit(True)))
    dealt = rows.repartition(n, "bucket")
    return dealt.mapInArrow(run, "key long, number int, th long, xkey long, xnumber int, xth long")


def _places(p: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), dtype=[("key", "<i8"), ("number", "<u4"), ("th", "<i8")])
    out["key"], out["number"], out["th"] = p["key"], p["number"], _hash(p)
    return out


def _found(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    columns = [c for i in (y, x) for c in (p["key"][i], p["number"][i].astype(np.int32), _hash(p)[i])]
    return pa.record_batch([pa.array(c) for c in columns], names=["key", "number", "th", "xkey", "xnumber", "xth"])


#: What names a text, and a line.
TEXT, PLACE = ["key", "th"], ["key", "number", "th"]


def _numbers(lines: DataFrame) -> DataFrame:
    """``key, th, numbers``: the lines of each text."""
    return lines.groupBy(*TEXT).agg(F.collect_list("number").alias("numbers"))


def _word_sets(rows: DataFrame) -> DataFrame:
    """``xkey, xnumber, xth, words`` of the lines ``numbers``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lines = Lines(unpacked(batch.column(2)), only=batch.column(3))
        keys, th = (batch.column(i).to_numpy(zero_copy_only=False)[lines.text] for i in (0, 1))
        sets = [lines.words[a : a + n].tobytes() for a, n in zip(lines.first.tolist(), lines.n.tolist(), strict=True)]
        columns = [pa.array(keys), pa.array(lines.number.astype(np.int32)), pa.array(th), pa.array(sets, pa.binary())]
        return pa.record_batch(columns, names=["xkey", "xnumber", "xth", "words"])

    return arrow_pass(rows.select("key", "th", "data", "numbers"), "xkey long, xnumber int, xth long, words binary", work, 512)


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float, late: DataFrame | None = None) -> DataFrame:
    """``key, number, th`` of the later lines of ``pairs`` of which a candidate is as similar as ``threshold``.

    ``late``: the texts of the later lines, if they are at hand.
    """
    texts = texts.select(*TEXT, "data")
    late = texts if late is None else late.select(*TEXT, "data")
    wanted = pairs.select(F.col("xkey").alias("key"), F.col("xnumber").alias("number"), F.col("xth").alias("th")).distinct()
    sets = _word_sets(texts.join(_numbers(wanted).hint("shuffle_hash"), TEXT))
    later = pairs.join(sets, ["xkey", "xnumber", "xth"]).groupBy(*TEXT).agg(
        F.collect_list("number").alias("numbers"), F.collect_list("words").alias("words")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(unpacked(batch.column(2)), only=batch.column(3))
        place = {x: i for i, x in enumerate(zip(lines.text.tolist(), lines.number.tolist(), strict=True))}
        numbers, row = flat(batch.column(3))
        words = batch.column(4).flatten().to_pylist()
        out = set()
        for text, number, other in zip(row.tolist(), numbers.tolist(), words, strict=True):
            i = place.get((text, number))
            if i is None or (text, number) in out:
                continue
            a = lines.words[lines.first[i] : lines.first[i] + lines.n[i]]
            b = np.frombuffer(other, dtype=np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if shared >= threshold * (len(both) - shared) - EPS:
                out.add((text, number))
        texts, numbers = [x[0] for x in out], [x[1] for x in out]
        keys, th = (batch.column(i).take(pa.array(texts, pa.int64())) for i in (0, 1))
        return pa.record_batch([keys, pa.array(numbers, pa.int32()), th], names=PLACE)

    rows = late.join(later.hint("shuffle_hash"), TEXT).select("key", "th", "data", "numbers", "words")
    return arrow_pass(rows, "key long, number int, th long", work, 512).distinct()


def _bitmap(rows: DataFrame, ranks, threshold: float) -> bytes:
    """A bitmap of ``BITMAP`` bits of the prefix words of the lines ``numbers``."""

    def mark(batches):
        bits = np.zeros(BITMAP, dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lines = Lines(unpacked(part.column(2)), np.frombuffer(ranks.value, dtype=np.uint8), only=part.column(3))
                prefix = lines.prefix(threshold)
                line = np.repeat(np.arange(len(prefix)), prefix)
                place = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                bits[_bit(lines.words[lines.first[line] + place])] = True
        some = np.flatnonzero(bits.reshape(-1, PIECE).any(axis=1))
        parts = [np.packbits(p, bitorder="little").tobytes() for p in bits.reshape(-1, PIECE)[some]]
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], names=["part", "bits"])

    marked = rows.select("key", "th", "data", "numbers").mapInArrow(mark, "part int, bits binary")
    out = bytearray(BITMAP // 8)
    for part, bits in marked.groupBy("part").agg(F.bitmap_or_agg("bits")).collect():  # BITMAP bits
        out[part * PIECE // 8 : (part + 1) * PIECE // 8] = bits
    return bytes(out)


def _named(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` of ``key, th`` with the hash left out where no other text has the key."""
    out = rows.join(shared.withColumn("several", F.lit(True)), "key", "left")
    return out.withColumn("th", F.when(F.col("several"), F.col("th")).otherwise(F.lit(0).cast("long"))).select(*rows.columns)


def _judged(scan: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Dealt texts with ``numbers``, the lines that are the first of their class; these ``numbers`` by text; ``gone``, those
    of them that have an earlier partner, by text; and the shared keys."""
    spark: SparkSession = scan.sparkSession
    small_batches(spark)
    buckets = 4 * partitions(spark)
    scanned = saved(_scanned(scan), "line-scan")
    lines = scanned.where("part is null")
    shared = saved(lines.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("key"), "line-shared")
    first = lines.groupBy("cls").agg(F.min(F.struct(*PLACE)).alias("p")).select("p.*")
    first = saved(_numbers(_named(first, shared)), "line-classes")
    texts = dealt(_named(scan, shared), *TEXT, more=first)
    firsts = texts.where("numbers is not null")
    ranks = spark.sparkContext.broadcast(rarity(scanned).tobytes())
    released(spark)  # the shuffle of the texts, if the job that dealt them was still known when it ended
    found = _join(_postings(firsts, ranks, threshold, buckets), threshold, FIRST)
    earlier = F.array_sort(F.collect_set(F.struct("xkey", "xnumber", "xth")))
    found = found.groupBy(*PLACE).agg(F.slice(earlier, 1, FIRST).alias("x"))
    found = saved(found, "line-candidates", release=True)
    pairs = found.select(*PLACE, F.explode("x").alias("x")).select(*PLACE, "x.*")
    gone = saved(_verified(texts, pairs, threshold), "line-matches", release=True)
    more = found.where(F.size("x") >= FIRST).join(gone, PLACE, "left_anti").select(*PLACE)
    more = saved(more, "line-open")
    if not more.isEmpty():
        late = saved(texts.select(*TEXT, "data").join(_numbers(more).hint("shuffle_hash"), TEXT), "line-open-texts")
        words = spark.sparkContext.broadcast(_bitmap(late, ranks, threshold))
        rest = _join(
            _postings(firsts, ranks, threshold, buckets, words), threshold, None, _postings(late, ranks, threshold, buckets)
        )
        rest = saved(rest.distinct().join(pairs, [*PLACE, "xkey", "xnumber", "xth"], "left_anti"), "line-rest")
        gone = gone.union(saved(_verified(texts, rest, threshold, late), "line-matches"))
    return texts, first, _numbers(gone).withColumnRenamed("numbers", "gone"), shared


def _split(rows: DataFrame, carry: list[str], unpack: Callable = lambda x: x) -> DataFrame:
    """Each text's remaining lines; ``rows`` is the text, ``numbers, gone`` and the columns to carry.

    ``unpack`` gives the bytes of a text that is not null.
    """
    made = {"n_lines": "int", "removed_lines": "array<int>", "kept": "string"}
    schema = rows.select(*carry, *[F.lit(None).cast(kind).alias(name) for name, kind in made.items()]).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for text, numbers, gone in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = None if text is None else unpack(text)
            parts = [] if text is None else text.split(b"\n")
            stay = set(numbers or ()).difference(gone or ())
            out = [i for i, x in enumerate(parts) if i not in stay and x.split()]
            drop = set(out)
            counts.append(len(parts))
            removed.append(out)
            kept.append(b"\n".join([x for i, x in enumerate(parts) if i not in drop]) if out else text)
        columns = [pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())]
        names = [*carry, "n_lines", "removed_lines", "kept"]
        return pa.record_batch([*batch.columns[3:], *columns], names=names)

    return arrow_pass(rows, schema, work)


def _texts(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(key_of(id_col).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``id_col, n_lines, removed_lines, kept`` of each row; line numbers start at 0."""
    texts, _, gone, _ = _judged(_texts(df, id_col, text_col), threshold)
    rows = texts.join(gone.hint("shuffle_hash"), TEXT, "left").select("data", "numbers", "gone", "key")
    out = _split(rows, ["key"], lambda data: zstandard.ZstdDecompressor().decompress(data))
    return out.select(id_of("key").alias(id_col), "n_lines", "removed_lines", "kept")


def distinct_line_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with its columns, the text of each row reduced to the lines that stay.

    Rows of which every line with words is removed, because it stands in earlier rows, go.
    """
    _, first, gone, shared = _judged(_texts(docs, id_col, text_col), threshold)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col] or [F.lit(0).alias("none")])
    rows = _named(_texts(docs, id_col, text_col, rest.alias("rest")), shared)
    lines = first.join(gone.hint("shuffle_hash"), TEXT, "left")
    rows = rows.join(lines.hint("shuffle_hash"), TEXT, "left").select("text", "numbers", "gone", "rest")
    out = _split(rows, ["rest"])
    empty = (F.size("removed_lines") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~empty | F.col("kept").isNull())
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
