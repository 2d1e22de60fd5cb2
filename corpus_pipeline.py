"""From raw documents to packed training sequences: the text operators in a row.

Each stage reads what its predecessor wrote and keeps the columns of ``documents`` (the last returns
pieces of sequences).  Stages: quality classifier, line dedup, SimHash near-dedup, benchmark
decontamination, packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkwork.llm.stages import decontaminate, distinct_documents, distinct_lines, good_quality, sequences
from linkwork.session import ensure_checkpoint_dir

STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("simhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", decontaminate),
    ("packing", sequences),
]

#: Models and iterative joins: no SQL statement; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
