"""Helpers shared by the text operators: tables, saved intermediates, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwork.session import ensure_checkpoint_dir

#: Stands for a null identifier inside an operator: nulls sort before every number.
NULL_KEY = -(2**63)
#: Rows in an Arrow batch, on both sides of a Python worker's socket: documents are large rows.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_of(column: str) -> Column:
    """A document identifier as a non-null long; null ids share one key, the smallest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def id_of(column: str) -> Column:
    """The identifier behind ``key_of``."""
    return F.nullif(F.col(column), F.lit(NULL_KEY))


def small_batches(spark: SparkSession) -> None:
    """Have the session's Arrow batches hold ``BATCH_ROWS`` rows at most; Spark's own 10,000 texts take a worker, and the
    executor's buffers outside the heap, tens of MB each time.  A smaller setting stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def released(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark removes the shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write an intermediate to the shared folder of ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage and survives lost executors; the folder belongs to the session's
    checkpoint folder, whose owner removes it.  ``release``: the job's shuffle files go afterwards.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        released(spark)
    return spark.read.schema(df.schema).parquet(path)


def arrow_pass(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 512
) -> DataFrame:
    """``mapInArrow`` that hands ``work`` slices of at most ``rows`` rows, to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def dealt_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, th, data``: ids, text hashes and zstandard-packed texts, bucketed by key (see ``dealt``)."""
    text = F.col(text_col).cast("string")
    return dealt(df.select(key_of(id_col).alias("key"), F.xxhash64(text).alias("th"), text.alias("text")), "key")


def dealt(rows: DataFrame, *by: str, more: DataFrame | None = None) -> DataFrame:
    """``key, th, data`` from ``key, th, text``: zstandard-packed texts, bucketed by ``by``; null texts have null data.

    ``more``: one row at most for each ``by``, of which the further columns join the texts as they are dealt (null if
    there is none).  The texts are shuffled once and written as a bucketed table under ``spark.checkpoint.dir``.  Every later join
    on ``by``, in whatever job, reads the buckets in place and shuffles its other side only.
    """
    spark = rows.sparkSession
    n = partitions(spark)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        data = pa.array([None if t is None else pack(t) for t in texts], pa.binary())
        return pa.record_batch([batch.column(0), batch.column(1), data], names=["key", "th", "data"])

    name = f"packed_texts_{uuid.uuid4().hex}"
    packed = arrow_pass(rows, "key long, th long, data binary", work).repartition(n, *by)
    if more is not None:
        packed = packed.join(more.hint("shuffle_hash"), list(by), "left")
    # the bytes are packed already
    table_of = packed.write.format("parquet").option("compression", "none").bucketBy(n, *by)
    table_of.option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    released(spark)
    return spark.table(name)


def unpacked(column: pa.Array) -> list[bytes]:
    """The texts behind a ``data`` column; null counts as empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else unpack(x) for x in column.to_pylist()]
