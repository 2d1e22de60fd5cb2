"""SimHash near-duplicate groups by BK-trees (operator 10).

Each text gets the 64-bit majority fingerprint of its word shingles.  Distinct fingerprints
at most ``radius`` bits apart are linked, and documents are grouped by the links.

Two fingerprints within ``radius`` bits agree on at least ``radius`` of ``2 radius`` disjoint bit
blocks (three of six), so a shard is one value of one choice of half the blocks: some 32 bits, which few
fingerprints share that are not alike.  Every shard has a BK-tree: a child hangs under
its integer Hamming distance to the parent, and a search follows only the edges within the
radius of the query's own distance.  A shard of more than ``shard_rows`` fingerprints, alike as they are, is cut
into several trees and the shard's fingerprints are sent to all of them, so no tree grows with
the data.  A tree task returns a spanning forest of the links it found, at most one row for
each fingerprint, never all pairs.  Groups come from alternating star contraction, a few
joins over that forest.

Defined cases: a null text counts as empty; a text without words has fingerprint 0, which
links like any other; null ids share one identity, the smallest; repeated rows keep one output
row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, id_of, key_of, partitions, saved, utf8
from linkwork.llm.components import components

BITS = 64
MASK = 2**64 - 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority fingerprint of one text, as a signed 64-bit number."""
    words = text.lower().split()  # bytes: lower() is A-Z only, split() is exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, longs: tuple[str, ...] = ()) -> DataFrame:
    """``key, fp`` for every row, and its long columns ``longs``."""
    names = ["key", "fp", *longs]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in utf8(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=names)

    rows = df.select(key_of(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), *longs)
    return arrow_pass(rows, ", ".join(f"{n} long" for n in names), work)


class BKTree:
    """A BK-tree over 64-bit numbers."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert and return the node's number (that of an equal value, if there)."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            if d == 0:
                return node
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            node = below

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits away."""
        if not self.values:
            return []
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                out.append(node)
            todo += [c for e, c in self.children[node].items() if d - radius <= e <= d + radius]
        return out


class Forest:
    """A BK-tree and a spanning forest of the links to its members (unsigned numbers)."""

    def __init__(self):
        self.tree, self.parent = BKTree(), []

    def root(self, x: int) -> int:
        while (up := self.parent[x]) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, nodes: list[int]) -> None:
        for node in nodes[1:]:
            a, b = self.root(nodes[0]), self.root(node)
            self.parent[max(a, b)] = min(a, b)

    def add(self, value: int, radius: int) -> None:
        """A member: linked with the members before it, then hung into the tree."""
        near = self.tree.near(value, radius)
        node = self.tree.add(value)
        if node == len(self.parent):
            self.parent.append(node)
        self.join([node, *near])

    def ask(self, value: int, radius: int) -> int | None:
        """A query: links the members near it; one of them, if any."""
        near = self.tree.near(value, radius)
        self.join(near)
        return self.tree.values[near[0]] if near else None

    def rows(self) -> list[tuple[int, int]]:
        """(member, root) rows."""
        values = self.tree.values
        return [(values[x], values[r]) for x in range(len(values)) if (r := self.root(x)) != x]


def _halves(radius: int) -> list[int]:
    """Masks, as signed numbers, of every choice of half of ``2 radius`` blocks of bits."""
    if radius == 0:
        return [-1]
    cuts = [round(i * BITS / (2 * radius)) for i in range(2 * radius + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(values: DataFrame, radius: int = 3, shard_rows: int = 32768) -> DataFrame:
    """``u, v``: a forest whose components are those of all links within ``radius``.

    ``values`` has one column ``fp`` of distinct fingerprints.
    """
    shards = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_halves(radius))])
    rows = values.select("fp", F.explode(shards).alias("s")).select("s.block", "s.part", "fp")
    # a fingerprint alone in its shard has no partner there
    sizes = rows.groupBy("block", "part").count().where("count > 1")
    sizes = sizes.select("block", "part", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees"))
    cut = rows.join(sizes, ["block", "part"])
    home = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    cut = cut.withColumn("home", home).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    cut = cut.select("block", "part", "tree", "fp", (F.col("tree") == F.col("home")).alias("member"))

    def search(batches):
        shard, forest, found = None, Forest(), []

        def rows(pairs):
            sides = [np.array([p[i] for p in pairs], dtype=np.uint64).view(np.int64) for i in (0, 1)]
            return pa.record_batch([pa.array(x) for x in sides], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for block, part, tree, fp, member in zip(*columns, strict=True):
                if (block, part, tree) != shard:
                    found += forest.rows()
                    shard, forest = (block, part, tree), Forest()
                if member:  # a shard's members come first
                    forest.add(fp & MASK, radius)
                elif (near := forest.ask(fp & MASK, radius)) is not None:
                    found.append((fp & MASK, near))
            if found:
                yield rows(found)
                found = []
        if found := forest.rows():
            yield rows(found)

    n = partitions(values.sparkSession)
    dealt = cut.repartition(n, "block", "part", "tree").sortWithinPartitions("block", "part", "tree", F.desc("member"))
    return dealt.mapInArrow(search, "u long, v long").distinct()


def rooted(values: DataFrame, radius: int = 3, shard_rows: int = 32768) -> DataFrame:
    """``values`` (distinct ``fp`` and further columns) with ``root``, which the fingerprints of a group share."""
    found = components(links(values.select("fp"), radius, shard_rows))
    out = values.join(found, values.fp == found.node, "left").select(*values.columns, F.coalesce("root", "fp").alias("root"))
    return saved(out, "simhash-roots")


def simhash_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    shard_rows: int = 32768,
) -> DataFrame:
    """``id_col, fingerprint, component_id``: one row for each input row.

    ``component_id`` is the smallest id that links reach from the row, itself included.
    """
    rows = saved(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    values = saved(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-values")
    roots = rooted(values, radius, shard_rows)
    linked = roots.groupBy("root").agg(F.min("least").alias("component"))
    by_value = roots.join(linked, "root").select("fp", "component")
    return rows.join(by_value, "fp").select(
        id_of("key").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_of("component").alias("component_id"),
    )
