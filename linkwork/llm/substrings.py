"""Removal of repeated passages by de Bruijn compaction (operator 7).

A window of ``k`` words is an edge of the de Bruijn graph: from the node of its first ``k - 1`` words to
that of its last.  Of edges that occur more than once, nonbranching paths (each inner node
is entered from one word and left by one word, in all its places) are compacted: one join
gives each occurrence the branch flags of its edge, and a document cuts its chain of
edges at the flagged nodes.  As an inner node has one way in and one way out, each occurrence of a
path runs through the whole of it, so a path is named by its first edge and length; no rounds of
pointer jumping are needed.  A 128-bit digest of the words at the source coordinates verifies that
spans of one name are equal before anything is removed.

Edges are made only for windows whose sampled hash has been seen in two documents
(``sampling``), and documents that copy a smaller id's whole text are settled by its hash.

The rule: a word goes if a window that covers it also starts in a document with a smaller id,
judged on the input.  Defined cases: a null text has no words; null ids share one identity, the
smallest; rows of one id never remove each other's words; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, dealt_texts, id_of, key_of, saved, unpacked
from linkwork.llm.sampling import changes, copies, flat, lookup, sample, shared
from linkwork.llm.tokens import Words, grams, inside

#: Words of a gram that represents a window.
GRAM = 6
#: The two low bits of an edge's hash make room for its branch flags.
FLAGS = np.int64(-4)
ROWS = 1024


def _edges(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes()
    return h, grams(h, k).view(np.int64) & FLAGS


def _samples(base: DataFrame, k: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(unpacked(batch.column(2)))
        h = words.hashes()
        least, ok = sample(h, words.owner, k, min(GRAM, k))
        at = changes(least, ok, words.owner)
        keys = batch.column(0).to_numpy(zero_copy_only=False)[words.owner[at]]
        return pa.record_batch([pa.array(least[at].view(np.int64)), pa.array(keys)], names=["h", "key"])

    return arrow_pass(base.select("key", "th", "data"), "h long, key long", work, ROWS)


def _occurrences(rows: DataFrame, k: int) -> DataFrame:
    """``e, key, before, after`` of the sampled windows of ``key, th, data, hs``; 0 is a text's end."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(unpacked(batch.column(2)))
        h, e = _edges(words, k)
        least, ok = sample(h, words.owner, k, min(GRAM, k))
        values, row = flat(batch.column(3))
        hit = lookup(words.owner[: len(least)], least.view(np.int64), row, values) >= 0
        at = np.flatnonzero(hit & ok)
        if not len(at):
            return None
        near = np.concatenate([[0], (h >> np.uint64(33)).astype(np.int64) + 1, [0]])
        last = at + k
        owner = np.append(words.owner, -1)
        before = np.where((at > 0) & (owner[at - 1] == owner[at]), near[at], 0)
        after = np.where(owner[last] == owner[at], near[last + 1], 0)
        keys = batch.column(0).to_numpy(zero_copy_only=False)[words.owner[at]]
        columns = [pa.array(e[at]), pa.array(keys), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))]
        return pa.record_batch(columns, names=["e", "key", "before", "after"])

    return arrow_pass(rows, "e long, key long, before int, after int", work, ROWS)


def _spans(rows: DataFrame, k: int) -> DataFrame:
    """``first, edges, digest, key, start``: the compacted paths in the texts of ``key, th, data, es``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(unpacked(batch.column(2)))
        _, e = _edges(words, k)
        if not len(e):
            return None
        values, row = flat(batch.column(3))
        place = lookup(words.owner[: len(e)], e, row, values & FLAGS)
        live = (place >= 0) & inside(words.owner, k)
        flags = np.where(live, values[place] & ~FLAGS, 0)
        at = np.flatnonzero(live)
        if not len(at):
            return None
        joined = np.zeros(len(at), dtype=bool)
        joined[1:] = (
            (at[1:] == at[:-1] + 1)
            & (words.owner[at[1:]] == words.owner[at[:-1]])
            & (flags[at[:-1]] & 2 == 0)
            & (flags[at[1:]] & 1 == 0)
        )
        heads = np.flatnonzero(~joined)
        start, size = at[heads], np.diff(np.append(heads, len(at)))
        check = np.stack([words.hashes(1), words.hashes(2)], axis=1)
        digests = [
            hashlib.blake2b(check[a : a + n + k - 1].tobytes(), digest_size=16).digest()
            for a, n in zip(start.tolist(), size.tolist(), strict=True)
        ]
        owner = words.owner[start]
        columns = [
            pa.array(e[start]),
            pa.array(size.astype(np.int32)),
            pa.array(digests, pa.binary()),
            pa.array(batch.column(0).to_numpy(zero_copy_only=False)[owner]),
            pa.array((start - words.word_at[owner]).astype(np.int32)),
        ]
        return pa.record_batch(columns, names=["first", "edges", "digest", "key", "start"])

    return arrow_pass(rows, "first long, edges int, digest binary, key long, start int", work, ROWS)


def repeated_spans(base: DataFrame, same: DataFrame, k: int) -> DataFrame:
    """``key, first, edges, start, source``: spans of ``dealt_texts`` that also start in a smaller key, ``source``."""
    later = base.join(same.hint("shuffle_hash"), "key", "left")
    fresh = later.where(~F.coalesce(F.array_contains("same", F.col("th")), F.lit(False)))
    hits = shared(_samples(fresh, k)).groupBy("key").agg(F.collect_list("h").alias("hs"))
    sampled = base.join(hits.hint("shuffle_hash"), "key").select("key", "th", "data", "hs")
    occurrences = _occurrences(sampled, k)
    nodes = occurrences.groupBy("e").agg(
        F.count("*").alias("n"),
        (F.min("before") != F.max("before")).alias("forks"),
        (F.min("after") != F.max("after")).alias("splits"),
    )
    nodes = nodes.where("n > 1").select("e", (F.col("forks").cast("long") + 2 * F.col("splits").cast("long")).alias("f"))
    marked = occurrences.select("e", "key").join(nodes.hint("shuffle_hash"), "e")
    edges = marked.groupBy("key").agg(F.collect_list(F.col("e").bitwiseOR(F.col("f"))).alias("es"))
    spans = saved(_spans(base.join(edges.hint("shuffle_hash"), "key").select("key", "th", "data", "es"), k), "debruijn-spans", release=True)
    least = spans.groupBy("first", "edges", "digest").agg(F.min("key").alias("source"))
    return spans.join(least, ["first", "edges", "digest"]).where("key > source").drop("digest")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """``id_col, n_words, n_removed, kept``: each text's remaining words, joined by one space."""
    base = dealt_texts(df, id_col, text_col)
    same = saved(copies(df, id_col, text_col), "debruijn-copies")
    spans = repeated_spans(base, same, k).select("key", F.struct("first", "edges").alias("s")).distinct()
    marks = spans.groupBy("key").agg(F.collect_list("s.first").alias("firsts"), F.collect_list("s.edges").alias("sizes"))
    side = marks.join(same, "key", "full")
    rows = base.join(side.hint("shuffle_hash"), "key", "left").select(
        "key", "th", "data", "firsts", "sizes", F.coalesce(F.array_contains("same", F.col("th")), F.lit(False)).alias("copy")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = unpacked(batch.column(2))
        firsts, row = flat(batch.column(3))
        sizes, _ = flat(batch.column(4))
        marked = np.zeros(len(texts), dtype=bool)
        marked[row] = True
        copy = batch.column(5).to_pylist()
        total, gone = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        kept: list[str] = []
        some = [t if m and not c else b"" for t, m, c in zip(texts, marked, copy, strict=True)]
        words = Words(some)
        _, e = _edges(words, k)
        place = lookup(words.owner[: len(e)], e, row, firsts & FLAGS)
        at = np.flatnonzero((place >= 0) & inside(words.owner, k))
        step = np.zeros(len(words.owner) + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + sizes[place[at]] + k - 1, -1)
        out = np.cumsum(step)[:-1] > 0
        for i, text in enumerate(texts):
            if marked[i] and not copy[i]:
                a, b = words.word_at[i], words.word_at[i + 1]
                stay = np.flatnonzero(~out[a:b]) + a
                total[i], gone[i] = b - a, b - a - len(stay)
                spans = zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)
                kept.append(b" ".join([words.buf[s:t] for s, t in spans]).decode())
                continue
            own = text.split()
            total[i] = len(own)
            if copy[i] and len(own) >= k:
                gone[i] = len(own)
                own = []
            kept.append(b" ".join(own).decode())
        columns = [batch.column(0), pa.array(total), pa.array(gone), pa.array(kept, pa.string())]
        return pa.record_batch(columns, names=["key", "n_words", "n_removed", "kept"])

    out = arrow_pass(rows, "key long, n_words long, n_removed long, kept string", work, ROWS)
    return out.select(id_of("key").alias(id_col), "n_words", "n_removed", "kept")
