"""The stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

Every stage takes rows with null or repeated ids, null, empty and very long texts, repeated rows, no rows, and further
columns of any name; all but the last return the columns that they got.  A null text counts as empty; what a stage does
with ties and copies is stated at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwork.llm import benchmarks, lines, packing, quality, queries, simhash
from linkwork.llm.common import key_of, saved, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    # the text goes to the Python worker and back once, the other columns in a struct beside it
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    scored = quality.score(docs.select(others, "text"), model, keep_text=True)
    text = F.col("_text").cast(docs.schema["text"].dataType).alias("text")
    return scored.where("score >= 0.5").select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, or nearly stand, earlier; documents left without any go."""
    out = lines.distinct_line_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: of the rows with the smallest id the one with the smallest text hash.

    A row is known by its id and 128 bits of hash of its text, so rows that share an id, or have none, stand for
    themselves.  Copies of the chosen row are told apart by their further columns.
    """
    small_batches(spark)
    text = F.col("text").cast("string")
    hashes = [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]
    # the input's columns travel in a struct, so none of their names can clash
    rows = docs.select(key_of("doc_id").alias("id"), *hashes, text.alias("text"), F.struct(*docs.columns).alias("row"))
    prints = saved(simhash.fingerprints(rows, "id", longs=("a", "b")), "stage-fp")
    roots = simhash.rooted(saved(prints.select("fp").distinct(), "stage-values"))
    known = prints.groupBy("fp", F.col("key").alias("id"), "a", "b").agg(F.count("*").alias("copies"))
    first = F.min(F.struct("id", "a", "b", "copies")).alias("first")
    heads = saved(known.join(roots, "fp").groupBy("root").agg(first).select("first.*", "root"), "stage-heads")
    kept = rows.select("id", "a", "b", "row").join(heads, ["id", "a", "b"])
    order = F.struct(*[F.col("row")[c].cast("string") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    repeated = kept.where("copies > 1").groupBy("root").agg(F.min_by("row", order).alias("row"))
    return kept.where("copies = 1").select("row.*").unionByName(repeated.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return benchmarks.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    small_batches(spark)
    return packing.pack(docs, queries.word_bpe())
