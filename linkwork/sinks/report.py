"""Reports: per-link report rows and summary (K1, A3) and the duplicate report text (K7).

A run is named by a ``job_id`` argument (the tool uses ``job_<timestamp>_<file stem>``);
nothing reads the clock, so reports are reproducible and comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_string
from ..operators.ordinal import with_ordinal

REPORT_FIELDS = ["original_title", "clean_title", "formatted_label", "domain", "url", "is_valid", "status_code"]


def job_id_for(stem: str, timestamp: str) -> str:
    """``job_YYYYMMDD_HHMMSS_<stem>``; the timestamp is passed in."""
    return f"job_{timestamp}_{stem}"


def _with_status(links: DataFrame) -> DataFrame:
    """Validation fields are null when no status was attached."""
    out = links
    for c, t in (("is_valid", "boolean"), ("status_code", "int")):
        if c not in links.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out


def report_rows(links: DataFrame, job_id: str) -> DataFrame:
    """K1 flat rows: one per link."""
    return _with_status(links).select(F.lit(job_id).alias("job_id"), "collection_id", "pos", *REPORT_FIELDS)


def report_summary(links: DataFrame, job_id: str) -> DataFrame:
    """A3: ``total_bookmarks`` per collection plus the three fixed flags of the report header."""
    return links.groupBy("collection_id").agg(F.count(F.lit(1)).alias("total_bookmarks")).select(
        F.lit(job_id).alias("job_id"), "collection_id", "total_bookmarks",
        F.lit(True).alias("original_structure_preserved"), F.lit(True).alias("labels_cleaned"),
        F.lit(True).alias("duplicates_handled"))


#: Lines of one link, and those before the first one, in the nested report.
ITEM_LINES, HEAD_LINES = 9, 11


def report_json_lines(links: DataFrame, job_id: str, generation_date: str, source_col: str = "collection_id") -> DataFrame:
    """K1 nested: the JSON report of each collection as ordered lines ``(collection_id, line_no, line)``.

    The lines, joined, are one JSON text, indented by two; a link takes nine lines at a place that follows from its
    rank, so a collection of any size is written by many tasks (``write_lines``).  ``source_col`` holds the source file.
    """
    rows = with_ordinal(_with_status(links), ["collection_id"], "pos", "_n", total="_all")
    heads = rows.groupBy("collection_id").agg(F.max("_all").alias("_all"), F.first(source_col).alias("_source"))
    text = lambda v: json_string(F.lit(v))
    # fixed values: the layout of the report
    head = F.array(
        F.lit("{"), F.concat(F.lit('  "generation_date": '), text(generation_date), F.lit(",")),
        F.concat(F.lit('  "source_file": '), F.coalesce(json_string(F.col("_source")), F.lit("null")), F.lit(",")),
        F.concat(F.lit('  "job_id": '), text(job_id), F.lit(",")), F.lit('  "summary": {'),
        F.concat(F.lit('    "total_bookmarks": '), F.col("_all").cast("string"), F.lit(",")),
        F.lit('    "original_structure_preserved": true,'), F.lit('    "labels_cleaned": true,'), F.lit('    "duplicates_handled": true'),
        F.lit("  },"), F.lit('  "bookmarks": ['))
    top = heads.select("collection_id", F.posexplode(head).alias("line_no", "line"))
    value = {c: json_string(F.col(c)) for c in REPORT_FIELDS} | {
        "is_valid": F.col("is_valid").cast("string"), "status_code": F.col("status_code").cast("string")}
    fields = [F.concat(F.lit(f'      "{c}": '), F.coalesce(value[c], F.lit("null")), F.lit("," if c != REPORT_FIELDS[-1] else ""))
              for c in REPORT_FIELDS]
    close = F.when(F.col("_n") < F.col("_all"), F.lit("    },")).otherwise(F.lit("    }"))
    items = rows.select("collection_id", "_n", F.posexplode(F.array(F.lit("    {"), *fields, close)).alias("_k", "line"))
    items = items.select("collection_id", (F.lit(HEAD_LINES) + (F.col("_n") - 1) * ITEM_LINES + F.col("_k")).alias("line_no"), "line")
    ends = heads.select("collection_id", "_all", F.posexplode(F.array(F.lit("  ]"), F.lit("}"))).alias("_k", "line"))
    ends = ends.select("collection_id", (F.lit(HEAD_LINES) + F.col("_all") * ITEM_LINES + F.col("_k")).alias("line_no"), "line")
    return top.unionByName(items).unionByName(ends).withColumn("line_no", F.col("line_no").cast("bigint"))


def duplicate_report_lines(members: DataFrame, metrics: DataFrame, strategy: str, threshold: float,
                           keep: str) -> DataFrame:
    """K7 as ordered lines ``(collection_id, line_no, line)``.

    ``members``: ``(collection_id, group_no, size, member_no, pos)``, groups of any size; ``metrics``:
    ``(collection_id, rows_removed, ...)``.  A group takes two lines and one for each member; a running sum of these
    numbers places it.  A collection without groups gets the single line ``No duplicates found.``
    """
    heads = members.filter(F.col("member_no") == 1).select("collection_id", "group_no", "size")
    heads = with_ordinal(heads.withColumn("_lines", F.col("size") + 2), ["collection_id"], "group_no", "_upto", weight="_lines")
    heads = heads.select("collection_id", "group_no", "size", (F.lit(7) + F.col("_upto") - F.col("_lines")).alias("_at"))
    groups = heads.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_g"))
    top = metrics.join(groups, "collection_id", "left").select(
        "collection_id", F.coalesce(F.col("_g"), F.lit(0)).alias("_g"), "rows_removed")
    # fixed values: the lines of the report
    header = F.array(
        F.lit(f"Duplicate Analysis Report - Strategy: {strategy}"),
        F.lit(f"Similarity Threshold: {threshold}"),
        F.lit(f"Keep Strategy: {keep}"),
        F.concat(F.lit("Total Duplicates Removed: "), F.col("rows_removed").cast("string")),
        F.concat(F.lit("Duplicate Groups Found: "), F.col("_g").cast("string")),
        F.lit(""), F.lit("Duplicate Groups:"))
    lines = F.when(F.col("_g") > 0, header).otherwise(F.array(F.lit("No duplicates found.")))
    top = top.select("collection_id", F.posexplode(lines).alias("line_no", "line"))
    title = F.concat(F.lit("Group "), F.col("group_no").cast("string"), F.lit(": "), F.col("size").cast("string"), F.lit(" duplicates"))
    titles = heads.select("collection_id", "_at", F.posexplode(F.array(F.lit(""), title)).alias("_k", "line"))
    titles = titles.select("collection_id", (F.col("_at") + F.col("_k")).alias("line_no"), "line")
    body = members.join(heads.select("collection_id", "group_no", "_at"), ["collection_id", "group_no"]).select(
        "collection_id", (F.col("_at") + 1 + F.col("member_no")).alias("line_no"),
        F.concat(F.lit("  - Index "), F.col("pos").cast("string")).alias("line"))
    out = top.unionByName(titles).unionByName(body)
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))
