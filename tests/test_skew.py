"""A hot key (a third or more of all rows on one URL/domain) must not be gathered into one window."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from linkwork.operators.dedup import DedupConfig, mark_duplicates
from linkwork.operators.labels import label_links


def _hot_links(spark, n_hot=20000, n_cold=10000):
    hot = spark.range(n_hot).select(F.lit("c").alias("collection_id"), (F.col("id") * 2).alias("pos"),
                                    F.lit("https://hot.com/page").alias("url"))
    cold = spark.range(n_cold).select(F.lit("c").alias("collection_id"), (F.col("id") * 2 + 1).alias("pos"),
                                      F.concat(F.lit("https://cold"), F.col("id").cast("string"), F.lit(".com/")).alias("url"))
    links = hot.unionByName(cold)
    return links.select("*", F.regexp_extract("url", "//([^/]*)", 1).alias("domain"),
                        F.lit("t").alias("original_title"), F.lit("t").alias("clean_title"),
                        F.lit(None).cast("string").alias("icon"), F.lit(None).cast("string").alias("add_date"),
                        F.lit("").alias("href"))


def _plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_hot_url_dedup_without_key_window(spark):
    links = _hot_links(spark).withColumn("formatted_label", F.concat("domain", F.lit(" | t")))
    for keep, kept_hot in (("first", 1), ("last", 19999), ("longest", 1)):
        m = mark_duplicates(links, DedupConfig("url", keep_strategy=keep))
        res = m.groupBy("domain").agg(F.count_if(~F.col("removed")).alias("kept")).collect()
        got = {r.domain: r.kept for r in res}
        assert got["hot.com"] == kept_hot and sum(got.values()) == kept_hot + 10000
    plan = _plan(mark_duplicates(links, DedupConfig("url")))
    assert "Window" not in plan  # per-key aggregates, not a window over the hot key


def test_hot_domain_labels(spark, monkeypatch):
    from linkwork.operators import ordinal

    monkeypatch.setattr(ordinal, "DEFAULT_BUCKET", 4096)  # the hot domain spans several buckets
    out = label_links(_hot_links(spark))
    hot = out.filter(F.col("domain") == "hot.com")
    assert hot.count() == 20000
    assert hot.select("formatted_label").distinct().count() == 20000
    last = hot.orderBy(F.col("pos").desc()).first()
    # "/page" falls back to the title "t", numbered in position order
    assert last.formatted_label == "hot.com | t 20000"
