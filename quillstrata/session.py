"""Session settings and the checkpoint folder used by the iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named in ``spark.checkpoint.dir``; pick a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="quillstrata-ckpt-")
    context.setCheckpointDir(configured)
    return configured


# Spark's estimate for a table of unknown size; no table has more bytes.
UNKNOWN_BYTES = 1 << 63


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one.

    A checkpoint keeps the planner's estimate of its size, and that of a join is a product. In a loop of joins its digits double with each
    round, until the number alone fills the driver; an estimate beyond any table is dropped instead.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    stored = df.checkpoint(eager=True)
    plan = stored._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() <= UNKNOWN_BYTES:
        return stored
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), stored._jdf.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """A stored table in at least as many partitions as there are cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
