"""Merkle fingerprints of documents (operator 9), in built-in column functions only.

A text is split into sections at blank lines, a section into paragraphs at line ends, a
paragraph into pieces that end with a sentence or after 32 characters.  A paragraph's hash is its MD5, a
section's the MD5 of its paragraphs' hashes, the root's the MD5 of the sections'.  Roots are equal exactly for equal texts;
where they differ, ``differing_branches`` goes down the differing sections only and names the paragraphs.

The fingerprint writes the tree as ``root:section=pieces,pieces/section=...``: per section the first 8
digits of its hash, per paragraph the 16 digits of each piece's 64-bit hash.  The likeness of two fingerprints is the
share of pieces they have in common, over the larger number of distinct pieces; equal fingerprints have 1.

Defined cases: a null text counts as empty; an empty text has one empty section; null ids share one
identity, the smallest; of several rows with one id, the one with the largest text stands for the "next" document; a
single document is next to itself; repeated rows keep a row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwork.llm.common import id_of, key_of, partitions, saved

PIECE = r"(?s)[^.!?]{1,32}[.!?]*\s*|[.!?]+\s*"


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _section(section: Column) -> Column:
    paragraphs = F.split(section, "\n", -1)
    return F.struct(
        F.md5(F.concat_ws(",", F.transform(paragraphs, lambda p: F.md5(p.cast("binary"))))).alias("hash"),
        F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x))).alias("pieces"),
    )


def _written(pieces: Column) -> Column:
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat_ws(",", F.transform(pieces, lambda p: F.concat_ws("", F.transform(p, digits))))


def with_fingerprint(df: DataFrame, text_col: str, name: str, parts_of: str | None = None) -> DataFrame:
    """``df`` with the fingerprint of a text column; ``parts_of`` names a column for its root and piece hashes."""
    parts = f"_{name}_parts"
    df = df.withColumn(parts, F.transform(F.split(_text(F.col(text_col)), "\n\n", -1), _section))
    root = F.md5(F.concat_ws("/", F.transform(parts, lambda s: s["hash"])))
    body = F.transform(parts, lambda s: F.concat(F.substring(s["hash"], 1, 8), F.lit("="), _written(s["pieces"])))
    out = df.withColumn(name, F.concat(root, F.lit(":"), F.concat_ws("/", body)))
    if parts_of:
        pieces = F.array_distinct(F.flatten(F.flatten(F.transform(parts, lambda s: s["pieces"]))))
        out = out.withColumn(parts_of, F.struct(root.alias("root"), pieces.alias("pieces")))
    return out.drop(parts)


def _share(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns, from 0 to 1."""
    bare = lambda c: F.regexp_replace(F.substring_index(c, ":", -1), "[0-9a-f]{8}=", "")
    pieces = lambda c: F.array_distinct(F.regexp_extract_all(bare(c), F.lit("[0-9a-f]{16}"), F.lit(0)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(_share(pieces(a), pieces(b)))


def _likeness(a: str, b: str) -> Column:
    """``likeness`` from the roots and piece hashes of two fingerprints."""
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), F.lit(1.0)).otherwise(_share(F.col(f"{a}.pieces"), F.col(f"{b}.pieces")))


def tree(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, section, section_hash, paragraph, hash, text_length``: the paragraphs of each text's tree."""
    sections = df.select(F.col(id_col), F.posexplode(F.split(_text(F.col(text_col)), "\n\n", -1)).alias("section", "_s"))
    whole = sections.select(id_col, "section", _section(F.col("_s"))["hash"].alias("section_hash"), "_s")
    rows = whole.select(id_col, "section", "section_hash", F.posexplode(F.split("_s", "\n", -1)).alias("paragraph", "_p"))
    return rows.select(
        id_col, "section", "section_hash", "paragraph", F.md5(F.col("_p").cast("binary")).alias("hash"), F.length("_p").alias("text_length")
    )


def differing_branches(before: DataFrame, after: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, section, paragraph, change``: where two versions of the documents differ.

    Sections with equal hashes are left out before paragraphs are compared.
    """
    a, b = tree(before, id_col, text_col), tree(after, id_col, text_col)
    sides = [t.select(id_col, "section", F.col("section_hash").alias(n)).distinct() for t, n in ((a, "x"), (b, "y"))]
    changed = sides[0].join(sides[1], [id_col, "section"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    changed = changed.select(id_col, "section")
    old, new = (t.join(changed, [id_col, "section"]) for t in (a, b))
    both = old.select(id_col, "section", "paragraph", F.col("hash").alias("x")).join(
        new.select(id_col, "section", "paragraph", F.col("hash").alias("y")), [id_col, "section", "paragraph"], "full"
    )
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(id_col, "section", "paragraph", change.alias("change"))


def following(sizes: DataFrame) -> DataFrame:
    """``sizes`` (one row for each ``key``) with ``next``: the next smaller key; for the smallest, the largest.

    Keys are dealt by range; only the range bounds, one row for each range, are ordered in one task.
    """
    n = partitions(sizes.sparkSession)
    dealt = saved(sizes.repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()), "merkle-ranges")
    bounds = dealt.groupBy("range").agg(F.max("key").alias("top"))
    bounds = bounds.select(
        "range",
        F.lag("top").over(Window.orderBy("range")).alias("below"),
        F.max("top").over(Window.partitionBy(F.lit(0))).alias("largest"),
    )
    inner = F.lag("key").over(Window.partitionBy("range").orderBy("key"))
    rows = dealt.withColumn("inner", inner).join(bounds, "range")
    return rows.select(*sizes.columns, F.coalesce("inner", "below", "largest").alias("next"))


def fingerprints_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last third is replaced by the next document's start.

    The next document is the one with the next smaller id.  Returns ``id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    texts = df.select(key_of(id_col).alias("key"), _text(F.col(text_col)).alias("text"))
    sizes = texts.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    need = following(sizes).select(F.col("key").alias("target"), F.col("next").alias("key"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    # one exchange of the texts serves both joins
    dealt = texts.repartition(partitions(df.sparkSession), "key")
    heads = dealt.join(need.hint("shuffle_hash"), "key")
    heads = with_fingerprint(heads, "text", "next_fingerprint", "next").select(
        "target", F.substr("text", F.lit(1), F.col("k")).alias("head"), "next"
    )
    heads = heads.groupBy("target").agg(F.max(F.struct("head", "next")).alias("h"))
    rows = dealt.join(heads, dealt["key"] == heads["target"]).withColumn("n", F.length("text"))
    rows = rows.withColumn("k", F.floor(F.col("n") / 3).cast("int"))
    kept = F.substr("text", F.lit(1), F.col("n") - F.col("k"))
    rows = rows.withColumn("edited", F.concat(kept, F.substr("h.head", F.lit(1), F.col("k"))))
    rows = with_fingerprint(rows, "text", "fingerprint", "_own")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", "_edited")
    return rows.select(
        id_of("key").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        _likeness("_own", "_edited").alias("near_edited"),
        _likeness("_own", "h.next").alias("near_next"),
    )
