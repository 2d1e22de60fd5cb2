"""Skew-safe ordinals with many buckets per key against plain window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkwork.operators.ordinal import with_ordinal


@pytest.mark.parametrize("bucket", [1, 3, 16])
def test_ordinal_and_running_sum_match_windows(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for c in ("a", "b"):
        positions = rng.sample(range(500), 120)
        for p in positions:
            rows.append((c, rng.choice(["x", "y", "hot", "hot", "hot"]), p, rng.randint(0, 5)))
    df = spark.createDataFrame(rows, "collection_id string, k string, pos bigint, w bigint")
    got = with_ordinal(df, ["collection_id", "k"], "pos", "o", total="t", bucket=bucket)
    got = with_ordinal(got, ["collection_id", "k"], "pos", "s", bucket=bucket, weight="w")
    w = Window.partitionBy("collection_id", "k")
    want = (df.withColumn("o", F.row_number().over(w.orderBy("pos")))
            .withColumn("t", F.count(F.lit(1)).over(w))
            .withColumn("s", F.sum("w").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))))
    a = sorted(tuple(r) for r in got.select("collection_id", "k", "pos", "o", "t", "s").collect())
    b = sorted(tuple(r) for r in want.select("collection_id", "k", "pos", "o", "t", "s").collect())
    assert a == b


def test_null_keys_keep_their_rows(spark):
    rows = [("a", 1), (None, 2), (None, 5)]
    df = spark.createDataFrame(rows, "collection_id string, pos bigint")
    got = {(r.collection_id, r.pos): r.n for r in with_ordinal(df, ["collection_id"], "pos", "n", bucket=2).collect()}
    assert got == {("a", 1): 1, (None, 2): 1, (None, 5): 2}
