"""Text exports (K4, K5, K6).  Each returns line rows ``(collection_id, line_no, line)``.

Lines carry their order as a column instead of being glued into one string, so a
collection of any size is written as numbered parts by many tasks (``write_lines``);
``join_lines`` glues them, for collections that fit in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import format_label, with_clean_title
from ..functions.urls import domain_of_sanitized, with_sanitized_url

FLAT_TITLE = "# Flattened Bookmarks List"
STRUCTURED_TITLE = "# Bookmarks with Original Structure Preserved"
# Our own wording for the organising instructions that precede the label list (K5).
DEFAULT_INSTRUCTIONS = """# Organise these bookmarks

Group the links below into folders and return them in this exact layout:

FOLDER: Top-level folder
  domain | title
  FOLDER: Subfolder
    domain | title

- "FOLDER: name" starts a folder; indent two spaces per level, at most three levels.
- Keep every bookmark line exactly as written ("domain | title").
- Put each bookmark in one folder only.

Bookmarks:
"""


def _header_rows(keys: DataFrame, lines: list[str]) -> DataFrame:
    arr = F.array(*[F.lit(x) for x in lines])
    return keys.select("collection_id", F.posexplode(arr).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


def _numbered(links: DataFrame, offset: int) -> DataFrame:
    from ..operators.ordinal import with_ordinal

    ranked = with_ordinal(links.select("collection_id", "pos", "formatted_label"), ["collection_id"], "pos", "_n")
    return ranked.select("collection_id", (F.col("_n") - 1 + F.lit(offset)).alias("line_no"),
                         F.col("formatted_label").alias("line"))


def flat_export(links: DataFrame) -> DataFrame:
    """K4: title line, blank line, one label per link in position order."""
    keys = links.select("collection_id").distinct()
    return _header_rows(keys, [FLAT_TITLE, ""]).unionByName(_numbered(links, 2))


def instructions_export(links: DataFrame, header: str = DEFAULT_INSTRUCTIONS) -> DataFrame:
    """K5: an instruction text, then one label per link (the text ends where the first label starts)."""
    head = header.split("\n")
    keys = links.select("collection_id").distinct()
    # the last header line and the first label share a line in the plain-text form
    first_label = _numbered(links, len(head) - 1)
    glued = first_label.filter(F.col("line_no") == len(head) - 1).select(
        "collection_id", "line_no", F.concat(F.lit(head[-1]), F.col("line")).alias("line"))
    rest = first_label.filter(F.col("line_no") > len(head) - 1)
    return _header_rows(keys, head[:-1]).unionByName(glued).unionByName(rest)


def structured_export(entries: DataFrame, links: DataFrame) -> DataFrame:
    """K6: title, blank, then folders as ``FOLDER: name`` and bookmarks as labels, two spaces per level.

    A bookmark's label is the label of the link with that URL (last one wins, J1); a URL
    with no link gets ``domain | cleaned title`` computed on the spot.
    """
    lookup = links.groupBy("collection_id", "url").agg(F.max_by("formatted_label", "pos").alias("_label"))
    e = entries.join(lookup, ["collection_id", "url"], "left")
    e = with_clean_title(with_sanitized_url(e, "url", "_su"), "title", "_ct")
    own = format_label(domain_of_sanitized(F.col("_su")), F.col("_ct"))
    text = F.when(F.col("type") == "folder", F.concat(F.lit("FOLDER: "), F.col("name"))) \
        .otherwise(F.coalesce(F.col("_label"), own))
    body = e.select("collection_id", (F.col("seq") + 2).alias("line_no"),
                    F.concat(F.repeat(F.lit("  "), F.col("depth")), text).alias("line"))
    keys = entries.select("collection_id").distinct()
    return _header_rows(keys, [STRUCTURED_TITLE, ""]).unionByName(body)


def join_lines(lines: DataFrame) -> DataFrame:
    """``(collection_id, text)`` for small collections: lines glued in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("collection_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write each collection's lines as numbered text parts under ``path/collection_id=...``.

    Rows are dealt by ranges of (collection, line number), so a collection of any size is written by many tasks; its
    parts, read one after the other in the order of their names, are the file.
    """
    (lines.repartitionByRange("collection_id", "line_no").sortWithinPartitions("collection_id", "line_no")
     .select("collection_id", "line").write.mode("overwrite").partitionBy("collection_id").text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lines`` wrote: ``(collection_id, part, line)``, each part's lines in its own order.

    ``part`` is the name of the part; parts sort by name.
    """
    raw = spark.read.text(path)
    return raw.select("collection_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.col("value").alias("line"))


__all__ = ["flat_export", "instructions_export", "structured_export", "join_lines", "write_lines", "read_lines"]
