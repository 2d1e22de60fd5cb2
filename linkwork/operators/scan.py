"""Running values and ranks over long ordered collections, without one task per collection.

``running`` is a segmented scan: rows are cut into stretches of positions, each stretch is scanned alone, and the
last value of each stretch is carried to the next ones through a table of one row per stretch.  ``sorted_places``
ranks rows by any sort columns: a global sort by ranges, places counted inside each range, plus the number of
rows in the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Positions of one stretch.
STRETCH = 1 << 16


def running(df: DataFrame, key: str, order_col: str, firsts: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, stretch: int | None = None) -> DataFrame:
    """Add the first and the last value so far, of those that are not null, of each named expression.

    "So far" means rows of the same ``key`` up to and with the row itself, by ``order_col`` (unique within the key).
    """
    firsts, lasts = firsts or {}, lasts or {}
    names = [*firsts, *lasts]
    df = df.withColumns({f"_v_{n}": e for n, e in {**firsts, **lasts}.items()})
    df = df.withColumn("_st", F.floor(F.col(order_col) / F.lit(stretch or STRETCH)))
    here = Window.partitionBy(key, "_st").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    pick = {n: (F.first if n in firsts else F.last) for n in names}
    inside = df.withColumns({f"_i_{n}": pick[n](f"_v_{n}", ignorenulls=True).over(here) for n in names})
    # a stretch's own first and last value; map-side, so a long collection is reduced before it is shuffled
    ends = df.groupBy(key, "_st").agg(*[
        (F.min_by if n in firsts else F.max_by)(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order_col))).alias(f"_e_{n}") for n in names])
    before = Window.partitionBy(key).orderBy("_st").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_ck"), F.col("_st").alias("_cs"),
                          *[pick[n](f"_e_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in names])
    out = inside.join(carried, F.col(key).eqNullSafe(F.col("_ck")) & F.col("_st").eqNullSafe(F.col("_cs")))
    value = {n: F.coalesce(f"_b_{n}", f"_i_{n}") if n in firsts else F.coalesce(f"_i_{n}", f"_b_{n}") for n in names}
    helpers = [f"_{p}_{n}" for p in "vib" for n in names]
    return out.withColumns(value).drop("_st", "_ck", "_cs", *helpers)


def sorted_places(df: DataFrame, key: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row among those of its ``key`` by ``order``, from 1.

    Rows that tie in ``order`` get places of their own, in any order.
    """
    placed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(F.col(key).alias("_ck"), part.alias("_cp")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy("_ck").orderBy("_cp").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    out = placed.join(counts, F.col(key).eqNullSafe(F.col("_ck")) & (part == F.col("_cp")))
    return out.withColumn(name, (F.col("_off") + F.col("_at") - F.col("_first") + 1).cast("bigint")).drop(
        "_at", "_ck", "_cp", "_off", "_first")
