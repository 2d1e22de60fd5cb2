"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app: str = "linkwork", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # documents are large rows: keep Arrow batches into the HTML parser small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.driver.memory", os.environ.get("LINKWORK_DRIVER_MEMORY", "8g"))
        # HotSpot does not JIT methods above 8000 bytes of bytecode; the regex-heavy cleaning
        # stages would run interpreted, so let Spark split such stages instead (Spark's advice)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # remove checkpoint files of intermediates once they are no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    """
    conf_dir = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="linkwork-ckpt-")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def materialize(df, how: str = "checkpoint"):
    """Make a reused intermediate computed once.

    ``checkpoint`` (default): reliable checkpoint into ``spark.checkpoint.dir``; the result is
    a small plan over the written files, survives executor loss and leaves no cache entry
    that later queries would have to match their plans against.
    ``cache``: ``persist(MEMORY_AND_DISK)``; lost blocks are recomputed from lineage.
    ``none``: leave the plan as is.
    """
    from pyspark import StorageLevel

    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        # persisted first so the checkpoint write does not compute the plan a second time
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    return df
