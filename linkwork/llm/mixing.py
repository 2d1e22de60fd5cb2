"""Mixing sources to target weights (operator 12).

A source's documents stand in a line, in the order of a keyed hash, and the line is cut into blocks of
``block_words`` words.  A source whose target is e times its size and r words takes every block e times and, in one
more permutation of the blocks, the first r words, so it meets its target to the word.  The draws of all sources are
dealt to output shards by a multivariate hypergeometric splitting tree (``splitting``): a shard gets a run of each
source's permuted draws, disjoint from every other's, and shuffles its blocks locally.

Only ids, sizes and hashes are shuffled, never texts.  The line is a global sort on (source, hash), so a source that
holds most rows is spread like the others; places in it come from sums per partition and source.  One task sees
one row per source (targets) or per source and node (tree).

Defined cases: a null text has no words, a null source is a source of its own, the last; documents without words
and sources without words take nothing; null and repeated ids and repeated rows stay, a row each; an empty table
gives no rows; further columns are ignored.  Results depend on the rows and the seed only, not on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, partitions, saved
from linkwork.llm.splitting import permuted, split

#: Weights by place of the source, repeating; a text is taken at most so many times.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: UTF-8 bytes that part words.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_counts(text: pa.Array) -> np.ndarray:
    """Runs of bytes other than spaces in each text, counted in the column's buffer at once."""
    text = text.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[ends[0]: ends[-1]]
    ends = ends - ends[0]
    word = ~SPACES[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = ends[:-1][ends[:-1] < ends[1:]]
    first[at] = word[at]  # a word that touches the text before is one of its own
    before = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return before[ends[1:]] - before[ends[:-1]]


def source_key(source: Column) -> Column:
    """The source as a string that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def line(docs: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """``at, id, source, size, upto``: documents by source and keyed hash; ``upto`` sums sizes within a partition.

    ``at`` numbers the rows: partition * 2^33 + place.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col("text").cast("string")
    rows = docs.select(F.col(id_col).alias("id"), source_key(F.col("source")).alias("source"), text.alias("text"))
    rows = rows.select("id", "source", F.xxhash64(F.lit(seed), "id", "source", "text").alias("h"), "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = pa.array(word_counts(batch.column(3)))
        return pa.record_batch([*batch.columns[:3], size], names=["id", "source", "h", "size"])

    sized = arrow_pass(rows, f"id {kind}, source string, h long, size long", count)
    # copies of a row are alike, so any order among them gives the same result
    sized = sized.withColumn("salt", F.monotonically_increasing_id())
    order = ["source", "h", "salt"]
    dealt = sized.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            sums = upto + np.cumsum(batch.column(2).to_numpy())
            upto = int(sums[-1]) if len(sums) else upto
            yield pa.record_batch([*batch.columns, pa.array(sums, pa.int64())], names=["id", "source", "size", "upto"])

    summed = dealt.select("id", "source", "size").mapInArrow(add, f"id {kind}, source string, size long, upto long")
    return saved(summed.select(F.monotonically_increasing_id().alias("at"), "*"), "mix-line")


def shares(sizes: list[int]) -> list[float]:
    """Targets of sources in their order: shares of all words by weight, stopped at ``MOST`` times a source's size."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), [i for i, z in enumerate(sizes) if z > 0]
    rest = sum(sizes)
    while free:
        heavy = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / heavy > MOST * sizes[i]]
        if not full:
            for i in free:
                out[i] = rest * weights[i] / heavy
            break
        for i in full:
            out[i] = float(MOST * sizes[i])
        rest -= sum(MOST * sizes[i] for i in full)
        free = [i for i in free if out[i] == 0.0]
    return out


def plans(totals: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per source of ``source, source_size``: its target and what it draws.

    ``epochs`` whole takes, ``rest`` words of one more, ``blocks`` of the line, ``quota`` draws in all, ``key`` of its permutations,
    ``short`` the place of its last, shorter block among the draws of the rest.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["source"].to_numpy(dtype=object), kind="stable")].reset_index(drop=True)
        sizes = [int(x) for x in pdf["source_size"]]
        targets = shares(sizes)
        words = [min(math.floor(t + 0.5), MOST * z) for t, z in zip(targets, sizes)]
        rows = []
        for z, t, w, key in zip(sizes, targets, words, pdf["key"].tolist()):
            blocks = -(-z // block_words)
            epochs, rest = divmod(w, z) if z else (0, 0)
            short = int(permuted(np.array([blocks - 1]), np.array([blocks]), np.array([key + epochs]))[0]) if rest else 0
            drawn = -(-rest // block_words)
            lacks = blocks * block_words - z  # of the last block
            if rest and short < drawn and drawn * block_words - lacks < rest:
                drawn += 1
            rows.append((t, epochs, rest, blocks, epochs * blocks + drawn, short))
        more = pd.DataFrame(rows, columns=["target", "epochs", "rest", "blocks", "quota", "short"])
        return pd.concat([pdf, more], axis=1)

    # keys of a source's permutations follow one another: room below the largest long
    key = F.shiftright(F.xxhash64(F.lit(seed), "source"), 2).alias("key")
    kind = "source string, source_size long, key long, target double, epochs long, rest long, blocks long, quota long, short long"
    return totals.select("source", "source_size", key).groupBy().applyInPandas(run, kind)


def _pieces(block_words: int):
    """The words that each drawn block takes of each document: ``at, draw, first, words, width`` of Arrow batches."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n not in ("id", "source")}
        begin, end = c["start"], c["start"] + c["size"]
        spans = np.where(c["size"] > 0, (end - 1) // block_words - begin // block_words + 1, 0)
        takes = c["epochs"] + (c["rest"] > 0)
        n = spans * takes
        row = np.repeat(np.arange(len(n)), n)
        if not len(row):
            return None
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        epoch, block = i // spans[row], (begin // block_words)[row] + i % spans[row]
        place = permuted(block, c["blocks"][row], c["key"][row] + epoch)
        size, blocks = c["source_size"][row], c["blocks"][row]
        lacks = blocks * block_words - size
        room = np.where(block == blocks - 1, block_words - lacks, block_words)
        before = place * block_words - np.where(c["short"][row] < place, lacks, 0)
        room = np.where(epoch < c["epochs"][row], room, np.clip(c["rest"][row] - before, 0, room))
        first = np.maximum(block * block_words, begin[row])
        words = np.minimum(block * block_words + room, end[row]) - first
        out = {"at": c["at"][row], "draw": epoch * blocks + place, "first": first - begin[row], "words": words, "epoch": epoch, "width": c["width"][row]}
        keep = words > 0
        arrays = [pa.array(v[keep].astype(np.int64)) for v in out.values()]
        source = batch.column(batch.schema.get_field_index("source"))
        return pa.record_batch([*arrays, source.take(pa.array(row[keep]))], names=[*out, "source"])

    return work


class Mix:
    """``documents``: a row per input row; ``pieces``: the mix itself."""

    def __init__(self, documents: DataFrame, pieces: DataFrame):
        self.documents, self.pieces = documents, pieces


def mix(docs: DataFrame, block_words: int = 1024, shard_words: int = 1 << 18, seed: int = 12, id_col: str = "doc_id") -> Mix:
    """Mix ``doc_id, text, source``.

    ``documents``: ``at, id, source, size, source_size, target``.  ``pieces``: ``at, first, words, epoch, source, draw, shard, place``: words
    ``first`` to ``first + words - 1`` of a document, at ``place`` (from 1) of an output shard of about ``shard_words`` words.
    """
    rows = line(docs, seed, id_col)
    part = F.shiftright("at", 33).alias("part")
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("size"), F.min(F.col("upto") - F.col("size")).alias("base"))
    sums = saved(sums, "mix-sums")  # a row per partition and source in it
    plan = saved(plans(sums.groupBy("source").agg(F.sum("size").alias("source_size")), block_words, seed), "mix-plans")
    quota = plan.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-quota * block_words // shard_words))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("shift", F.coalesce(F.sum("size").over(ahead), F.lit(0)) - F.col("base")).drop("size", "base")
    width = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.lit(shards))).cast("long").alias("width")
    known = sums.join(plan.select("*", width), "source")
    placed = rows.withColumn("part", part).join(known, ["source", "part"])
    placed = placed.withColumn("start", F.col("upto") - F.col("size") + F.col("shift"))

    fields = ["at", "size", "start", "source_size", "epochs", "rest", "blocks", "key", "short", "width", "source"]
    kind = "at long, draw long, first long, words long, epoch long, width long, source string"
    drawn = arrow_pass(placed.select(*fields), kind, _pieces(block_words))
    # a shard's run of a source's draws, by equal stretches of draws: a stretch meets few runs, a run few stretches
    runs = split(plan.select("source", "quota"), shards, seed).join(plan.select("source", width), "source")
    last = F.col("begin") + F.col("quota") - 1
    runs = runs.select("shard", "source", "begin", last.alias("last"), F.explode(F.sequence(F.expr("begin div width"), F.expr("(begin + quota - 1) div width"))).alias("stretch"))
    dealt = drawn.withColumn("stretch", F.expr("draw div width")).join(runs, ["source", "stretch"])
    dealt = dealt.where("draw between begin and last")
    turn = F.xxhash64(F.lit(seed), "source", "draw")
    local = Window.partitionBy("shard").orderBy(turn, "source", "draw", "at")
    pieces = dealt.select("at", "first", "words", "epoch", "source", "draw", "shard", F.row_number().over(local).alias("place"))
    documents = rows.join(plan.select("source", "source_size", "target"), "source")
    return Mix(documents.select("at", "id", "source", "size", "source_size", "target"), pieces)


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, pieces, shard, place``: what the mix takes of each document.

    ``shard`` and ``place`` are those of its first piece.
    """
    out = mix(docs, **options)
    first = F.min(F.struct("shard", "place")).alias("f")
    by = out.pieces.groupBy("at").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"), first)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.documents.join(by, "at", "left").select(
        F.col("id").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", zero("taken"), zero("pieces"), "f.shard", "f.place",
    )
