"""Session settings and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("surveyloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SURVEYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and restart its plan there. A
    lost executor costs no recomputation of earlier rounds. The files are coded far
    smaller than their rows; a side that grows with the input needs ``shuffled``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    # once the table is stored nothing reads the shuffles it was made of
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Marks a join side that grows with the input: both sides are shuffled. The optimizer
    knows a stored table by the size of its files, and ten megabytes of coded n-grams
    become hundreds as a broadcast, all of them built in the driver."""
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """Marks a join side that grows with the input but holds each key once: both sides are
    shuffled, a task keeps its share of this side and reads the other one unsorted."""
    return df.hint("shuffle_hash")


def lookup_side(df: DataFrame) -> DataFrame:
    """A derived lookup table (headers, titles, labels), written once. Its files tell the
    optimizer the true size in bytes, which alone decides between a broadcast and a
    shuffle join."""
    return cut_lineage(df)
