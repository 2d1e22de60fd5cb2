"""Link health from a status table.

Probing the network is a separate job; its results arrive as a table
``V(url, is_valid, status_code, error, checked_seq)``.  A received response is valid
whatever its status code; a link that was never checked has null status and is neither
valid nor broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import preview
from ..functions.urls import sanitize_url

INVALID_URL_ERROR = "Invalid or dangerous URL"
BROKEN_SHOWN = 10


def attach_status(links: DataFrame, status: DataFrame) -> DataFrame:
    """Left join of links to the latest status row of their URL."""
    state = F.struct("is_valid", "status_code", "error")
    # status URLs are sanitised as links are; rows of one sequence number are ordered by their state
    latest = status.withColumn("url", sanitize_url(F.col("url"))).filter(F.col("url") != "").groupBy("url").agg(
        F.max_by(state, F.struct("checked_seq", state)).alias("_s"))
    j = links.join(latest, "url", "left")
    bad = F.col("url") == ""
    return (j.withColumn("is_valid", F.when(bad, F.lit(False)).otherwise(F.col("_s.is_valid")))
             .withColumn("status_code", F.when(bad, F.lit(None).cast("int")).otherwise(F.col("_s.status_code")))
             .withColumn("error", F.when(bad, F.lit(INVALID_URL_ERROR)).otherwise(F.col("_s.error")))
             .drop("_s"))


def health_summary(checked: DataFrame) -> DataFrame:
    """A2 per collection: totals and the success rate (one decimal; null when nothing was checked)."""
    valid = F.count_if(F.col("is_valid") == F.lit(True))
    invalid = F.count_if(F.col("is_valid") == F.lit(False))
    agg = checked.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total"), valid.alias("valid"), invalid.alias("invalid"),
        F.count_if(F.col("is_valid").isNull()).alias("unchecked"))
    denom = F.col("valid") + F.col("invalid")
    rate = F.when(denom > 0, F.bround(F.col("valid").cast("double") / denom.cast("double") * F.lit(100.0), 1))
    return agg.withColumn("success_rate", rate)


def broken_links(checked: DataFrame, shown: int = BROKEN_SHOWN) -> DataFrame:
    """F3 + L2: the first ``shown`` broken links per collection and how many more there are."""
    broken = checked.filter(F.col("is_valid") == F.lit(False))
    counts = broken.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("collection_id").orderBy("pos")
    top = broken.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    return top.join(counts, "collection_id").select(
        "collection_id", "pos", preview(F.col("formatted_label"), 60).alias("label_preview"), "error",
        F.greatest(F.col("_n") - F.lit(shown), F.lit(0)).alias("more_broken"))
