"""Running values and places over long collections, and the ordered writer."""

import random

import pytest
from pyspark.sql import functions as F

from linkwork.operators.scan import running, sorted_places
from linkwork.sinks.export import read_lines, write_lines


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_running_values_over_stretches(spark, stretch):
    rng = random.Random(stretch)
    rows = [(c, p, rng.choice([None, None, p])) for c in ("a", "b", None) for p in rng.sample(range(200), 40)]
    df = spark.createDataFrame(rows, "c string, p bigint, v bigint").repartition(4)
    got = running(df, "c", "p", firsts={"f": F.col("v")}, lasts={"l": F.col("v")}, stretch=stretch).collect()
    assert len(got) == len(rows)
    for r in got:
        so_far = [v for c, p, v in sorted(rows, key=lambda x: x[1]) if c == r.c and p <= r.p and v is not None]
        assert (r.f, r.l) == ((so_far[0], so_far[-1]) if so_far else (None, None))


def test_places_of_a_hot_collection(spark):
    rng = random.Random(1)
    rows = [("hot", rng.random(), i) for i in range(3000)] + [("b", 0.5, 1), ("b", 0.5, 2), (None, 1.0, 3)]
    df = spark.createDataFrame(rows, "c string, x double, i int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted_places(df, "c", ["x", F.col("i").desc()], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for c in ("hot", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], -r[2])), 1):
            want[r] = n
    assert {(r.c, r.x, r.i): r.n for r in got} == want


def test_lines_of_one_collection_over_many_parts(spark, tmp_path):
    lines = spark.range(20000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("big").alias("collection_id"), F.col("id").alias("line_no"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_lines(lines, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "out" / "collection_id=big").glob("part-*"))
    assert len(parts) > 3
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text == [f"line {i}" for i in range(20000) if i % 50]
    assert {r.collection_id for r in read_lines(spark, str(tmp_path / "out")).select("collection_id").distinct().collect()} == {"big", "small"}
