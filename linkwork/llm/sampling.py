"""Which windows of a corpus can occur in two documents: an exact filter by sampled hashes.

Every window of ``k`` items is represented by the least hash of the ``k - q + 1`` grams of ``q`` items
inside it, a function of the window's content.  Equal windows share that hash, so a window
whose hash occurs in one document only cannot occur in another.  About ``2 / (k - q + 2)`` of the
gram hashes are chosen by some window; only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import key_of, partitions
from linkwork.llm.tokens import grams, inside, sliding_min


def sample(h: np.ndarray, owner: np.ndarray, k: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Least gram hash of each window of ``k`` items, and which windows lie within one text."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return sliding_min(grams(h, q), k - q + 1), inside(owner, k)


def changes(least: np.ndarray, ok: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Windows within one text at which a text's chosen hash changes."""
    at = np.flatnonzero(ok)
    if not len(at):
        return at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    return at[new]


def shared(samples: DataFrame) -> DataFrame:
    """Of ``h, key`` the rows whose ``h`` has two or more keys.

    The rows of one hash are read as a sorted stream, with three numbers kept, so a hash that a third
    of all documents have needs no more memory than any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash and key of the row before, and whether its hash has had another key
        for batch in batches:
            h, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(h):
                continue
            head = np.concatenate([[last is None or h[0] != last[0]], h[1:] != h[:-1]])
            other = ~head
            other[1:] &= key[1:] != key[:-1]
            if last is not None:
                other[0] &= key[0] != last[1]
            run_of = np.cumsum(head)
            seen = np.cumsum(other)
            runs, first = np.unique(run_of, return_index=True)
            base = (seen - other)[first]
            if last is not None and not head[0] and last[2]:
                base[0] -= 1  # the hash has already been seen in two documents
            size = np.diff(np.append(first, len(h)))
            after = seen - np.repeat(base, size)  # changes of key in this run so far
            total = np.repeat(after[first + size - 1], size)
            keep = total > 0
            repeat = np.zeros(len(h), dtype=bool)
            repeat[1:] = ~head[1:] & (key[1:] == key[:-1])
            out_key, out_h = key[keep & ~repeat], h[keep & ~repeat]
            if last is not None and not head[0] and not last[2] and total[0] > 0:
                out_key, out_h = np.append(out_key, last[1]), np.append(out_h, last[0])
            # a run that goes on: its last row may be sent again by the next batch, never lost
            last = (h[-1], key[-1], bool(total[-1] > 0))
            if len(out_h):
                yield pa.record_batch([pa.array(out_key), pa.array(out_h)], names=["key", "h"])

    n = partitions(samples.sparkSession)
    dealt = samples.repartition(n, "h").sortWithinPartitions("h", "key")
    return dealt.mapInArrow(run, "key long, h long")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    return values, np.repeat(np.arange(len(sizes)), sizes)


def lookup(rows: np.ndarray, values: np.ndarray, in_rows: np.ndarray, in_values: np.ndarray) -> np.ndarray:
    """For each (row, value): its place among the (in_rows, in_values), or -1."""
    if not len(in_values):
        return np.full(len(values), -1)
    order = np.lexsort((in_values, in_rows))
    # values of one row are sorted after those of the rows before: search within the row's stretch
    r, v = in_rows[order], in_values[order]
    uniq, code = np.unique(np.concatenate([v, values]), return_inverse=True)
    span = np.int64(len(uniq) + 1)
    have, want = r * span + code[: len(v)], rows * span + code[len(v) :]
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[at] == want, order[at], -1)


def copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, same``: the hashes of a key's texts that also stand, whole, in a smaller key."""
    text = F.col(text_col).cast("string")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    hashed = df.select(key_of(id_col).alias("key"), F.xxhash64(text).alias("th"), digest.alias("m"))
    first = hashed.groupBy("m").agg(F.min("key").alias("first"))
    later = hashed.join(first, "m").where("key > first")
    return later.groupBy("key").agg(F.collect_set("th").alias("same"))
