"""Skew-safe running ordinals and running sums.

``row_number() over (partition by k order by pos)`` sends every row of a key to one
task, so a key holding a third of the data becomes one task.  Here rows are first cut
into buckets of at most ``bucket`` consecutive positions (positions are unique within a
collection, so a bucket never holds more rows than that).  A small table of per-bucket
totals gives each bucket its offset, and the running value is taken inside the bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1 << 16


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    name: str,
    total: str | None = None,
    bucket: int | None = None,
    weight: str | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add ``name`` = 1-based rank of the row among rows with equal ``keys`` by ``order_col``.

    ``order_col`` must be unique within the keys.  With ``total`` also adds the key's total.
    With ``weight`` the value is the running sum of that column (inclusive, not negative) instead of the rank.
    ``keep_bucket`` keeps the ``_bk`` column; a later call on the same rows reuses it, and a
    finer key then needs no new shuffle (the rows are already partitioned by a subset of it).
    """
    keys = list(keys)
    bucket = bucket or DEFAULT_BUCKET
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    part = Window.partitionBy(*keys, "_bk")
    if "_bk" not in df.columns:
        df = df.withColumn("_bk", F.floor(F.col(order_col) / F.lit(bucket)))
    df = df.withColumn("_w", w)
    d = df.withColumn("_in", F.sum("_w").over(part.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)))
    # bucket totals are added up on the map side: the input is read twice, but shuffled and sorted once
    counts = df.groupBy(*keys, "_bk").agg(F.sum("_w").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_c").over(Window.partitionBy(*keys)))
    # null-safe: rows whose keys or position are null are numbered like any other
    same = [*keys, "_bk"]
    counts = counts.drop("_c").select(*[F.col(k).alias(f"_r_{k}") for k in same], *[c for c in counts.columns if c not in (*same, "_c")])
    out = d.join(counts, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in same]).drop(*[f"_r_{k}" for k in same])
    out = out.withColumn(name, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_off", "_in", "_w")
    return out if keep_bucket else out.drop("_bk")
