"""Reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, kind: str) -> str:
    """`spark.checkpoint.dir`.  Only a session on one machine may go without: it takes a new temporary
    folder, which executors on other machines would not see."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix=f"run-{kind}-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_folder(spark, "checkpoint"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_dir(spark: SparkSession) -> str:
    """New folder for intermediate tables beside the cluster's checkpoints."""
    return f"{_folder(spark, 'tables')}/tables-{uuid.uuid4().hex}"


def release_finished(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to.

    Spark does so when the driver collects its garbage, by itself every spark.cleaner.periodicGC.interval;
    asking between two phases keeps the texts of both from lying on the disks at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The rows as a scratch table, by columns and so smaller than in a checkpoint or a shuffle; the shuffle
    files they came from may go."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    df.write.parquet(folder)
    release_finished(spark)
    return spark.read.parquet(folder)
