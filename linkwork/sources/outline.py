"""Outline scan (S4): organised outline texts to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws


def outline_lines(outlines: DataFrame) -> DataFrame:
    """``(collection_id, text)`` -> ``(collection_id, line_no, line)``; the text is stripped first, lines count from 1."""
    return outlines.select("collection_id", F.posexplode(F.split(strip_ws(F.col("text")), "\n")).alias("_i", "line")) \
        .select("collection_id", (F.col("_i") + 1).cast("bigint").alias("line_no"), "line")
