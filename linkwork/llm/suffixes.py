"""Exact removal of repeated byte strings by suffix sorting (operator 8).

A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id,
judged on the input; matches never cross documents.

1. Windows whose sampled hash (``sampling``) occurs in one document only cannot repeat.  The other windows of a text
   are cut where the sampled hash changes; such a stretch, with the bytes its last window needs, goes to the
   shard of its hash, so that equal windows always meet.
2. A shard keeps each distinct stretch once, with the places where it occurs, and sorts the suffixes
   by external induced sorting (``induced``).  Neighbours whose common prefix reaches ``size`` are one content; its
   smallest id decides about every place.
3. The runs to remove return to their documents.

Documents that copy a smaller id's whole text are settled by its hash.  Defined cases: a null text is
empty; null ids share one identity, the smallest; rows of one id never remove each other's bytes; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, dealt_texts, id_of, partitions, saved, unpacked
from linkwork.llm.induced import Shard
from linkwork.llm.sampling import copies, flat, lookup, shared
from linkwork.llm.tokens import MIX, sliding_min

#: Bytes of a gram that represents a window; from 16 to 24, which three loads of 8 bytes cover.
GRAM = 20
ROWS = 256
#: Shards for each shuffle partition: a shard's arrays take some 50 bytes for each byte of its strings.
SHARDS = 4
#: Places that a shard settles in one go.
PLACES = 1 << 21


class Windows:
    """The windows of ``size`` bytes of several texts and their sampled hashes."""

    def __init__(self, texts: list[bytes], size: int, gram: int):
        self.buf = b"\n".join(texts) + b"\n" + b"\0" * 24
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(self.text_at[-1])
        count = max(0, n - size + 1)
        eight = np.ndarray((n + 16,), dtype="<u8", buffer=self.buf, strides=(1,))
        h = eight[:n] * MIX[0]
        h ^= h >> np.uint64(29)
        h += eight[8 : n + 8]
        h *= MIX[1]
        h ^= h >> np.uint64(32)
        h += eight[gram - 8 : n + gram - 8]
        h *= MIX[2]
        h ^= h >> np.uint64(31)
        self.least = sliding_min(h[: n - gram + 1], size - gram + 1) if count else h[:0]
        step = np.zeros(count + 1, dtype=np.int32)
        whole = np.flatnonzero(sizes >= size)
        np.add.at(step, self.text_at[whole], 1)
        np.add.at(step, self.text_at[whole] + sizes[whole] - size + 1, -1)
        self.ok = np.cumsum(step)[:-1] > 0

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.text_at, at, side="right") - 1

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run of windows of one text with one sampled hash."""
        at = np.flatnonzero(self.ok)
        if not len(at):
            return at, at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (self.least[at[1:]] != self.least[at[:-1]])
        first = np.flatnonzero(new)
        return at[first], at[np.append(first[1:], len(at)) - 1]


def _samples(base: DataFrame, size: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = Windows(unpacked(batch.column(2)), size, GRAM)
        at, _ = windows.stretches()
        keys = batch.column(0).to_numpy(zero_copy_only=False)[windows.owner(at)]
        return pa.record_batch([pa.array(windows.least[at].view(np.int64)), pa.array(keys)], names=["h", "key"])

    return arrow_pass(base.select("key", "th", "data"), "h long, key long", work, ROWS)


def _stretches(rows: DataFrame, size: int) -> DataFrame:
    """``h, key, th, start, data`` of the stretches that can repeat; ``th`` tells texts of one id apart."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        windows = Windows(unpacked(batch.column(2)), size, GRAM)
        first, last = windows.stretches()
        owner = windows.owner(first)
        values, row = flat(batch.column(3))
        h = windows.least[first].view(np.int64)
        hit = lookup(owner, h, row, values) >= 0
        first, last, owner, h = first[hit], last[hit], owner[hit], h[hit]
        data = [windows.buf[a : b + size] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        key = batch.column(0).to_numpy(zero_copy_only=False)[owner]
        th = batch.column(1).to_numpy(zero_copy_only=False)[owner].astype(np.int32)
        start = (first - windows.text_at[owner]).astype(np.int32)
        columns = [pa.array(h), pa.array(key), pa.array(th), pa.array(start), pa.array(data, pa.binary())]
        return pa.record_batch(columns, names=["h", "key", "th", "start", "data"])

    return arrow_pass(rows, "h long, key long, th int, start int, data binary", work, ROWS)


def settle(strings: list[bytes], string: np.ndarray, key: np.ndarray, size: int, memory: int):
    """For places of strings (with their ids): yield place, first and last window of each run to remove."""
    shard = Shard(strings, memory)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, string, key)
    owner = np.full(shard.n, np.iinfo(np.int64).max)
    for at, new in shard.equal_windows(size):
        first = np.flatnonzero(new)
        own = least[np.searchsorted(shard.at, at, side="right") - 1]
        owner[at] = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(at))))
    windows = np.diff(shard.at) - size
    counts = windows[string]
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(string):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + PLACES, side="right")))
        some = counts[begin:end]
        place = np.repeat(np.arange(begin, end), some)
        offset = np.arange(len(place)) - np.repeat(np.cumsum(some) - some, some)
        gone = np.flatnonzero(owner[shard.at[string[place]] + offset] < key[place])
        if len(gone):
            new = np.ones(len(gone), dtype=bool)
            new[1:] = (gone[1:] != gone[:-1] + 1) | (place[gone[1:]] != place[gone[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(gone)) - 1
            yield place[gone[head]], offset[gone[head]], offset[gone[tail]]
        begin = end


def _runs(stretches: DataFrame, size: int, memory: int) -> DataFrame:
    """``key, th, start, stop``: byte runs that go."""

    def run(batches):
        known: dict[bytes, int] = {}
        string, key, th, start = [], [], [], []
        for batch in batches:
            string.append(np.array([known.setdefault(x, len(known)) for x in batch.column(4).to_pylist()], dtype=np.int64))
            for into, i in ((key, 1), (th, 2), (start, 3)):
                into.append(batch.column(i).to_numpy(zero_copy_only=False))
        if not known:
            return
        string, key, th, start = (np.concatenate(x) for x in (string, key, th, start))
        for place, first, last in settle(list(known), string, key, size, memory):
            columns = [key[place], th[place], (start[place] + first).astype(np.int32), (start[place] + last + size).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "th", "start", "stop"])

    dealt = stretches.repartition(SHARDS * partitions(stretches.sparkSession), "h")
    return dealt.mapInArrow(run, "key long, th int, start int, stop int")


def remove_repeated_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, memory: int = 64 << 20
) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept``: each text's remaining bytes; ``size`` is at least ``GRAM``.

    ``memory``: bytes that a shard's queue and each of its arrays may take before they go to disk.
    """
    base = dealt_texts(df, id_col, text_col)
    same = saved(copies(df, id_col, text_col), "suffix-copies")
    later = base.join(same.hint("shuffle_hash"), "key", "left")
    fresh = later.where(~F.coalesce(F.array_contains("same", F.col("th")), F.lit(False)))
    hits = saved(shared(_samples(fresh, size)), "suffix-samples", release=True)
    hits = hits.groupBy("key").agg(F.collect_list("h").alias("hs"))
    rows = base.join(hits.hint("shuffle_hash"), "key").select("key", "th", "data", "hs")
    # not written: the last join below takes the runs as they come
    runs = _runs(_stretches(rows, size), size, memory)
    marks = runs.groupBy("key").agg(F.collect_list(F.struct("th", "start", "stop")).alias("runs"))
    marks = marks.select("key", "runs.th", "runs.start", "runs.stop")
    side = marks.withColumnRenamed("th", "of").join(same, "key", "full")
    rows = base.join(side.hint("shuffle_hash"), "key", "left").select(
        "key", "th", "data", "of", "start", "stop", F.coalesce(F.array_contains("same", F.col("th")), F.lit(False)).alias("copy")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = unpacked(batch.column(2))
        of, row = flat(batch.column(3))
        own = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
        mine = of == own[row] if len(of) else np.zeros(0, dtype=bool)
        row, start, stop = row[mine], flat(batch.column(4))[0][mine], flat(batch.column(5))[0][mine]
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        gone, spans, kept = [], [], []
        for i, (text, copy) in enumerate(zip(texts, batch.column(6).to_pylist(), strict=True)):
            a, b = begin[i], begin[i + 1]
            if copy and len(text) >= size:
                gone.append(len(text))
                spans.append(1)
                kept.append(b"")
            elif a == b:
                gone.append(0)
                spans.append(0)
                kept.append(text)
            else:
                step = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(step, start[a:b], 1)
                np.add.at(step, stop[a:b], -1)
                out = np.cumsum(step)[:-1] > 0
                gone.append(int(out.sum()))
                spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                kept.append(np.frombuffer(text, dtype=np.uint8)[~out].tobytes())
        columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())]
        columns += [pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        return pa.record_batch(columns, names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    out = arrow_pass(rows, "key long, n_bytes long, n_removed long, n_spans long, kept binary", work, ROWS)
    return out.select(id_of("key").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
