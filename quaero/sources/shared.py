"""Folders that the driver and all executors can read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset and all executors are on this machine, as in tests, a folder below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/quaero-checkpoints").rstrip("/")


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Lets DataFrames be checkpointed: the session's own folder stays, if it has one."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
