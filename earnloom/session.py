"""Session set-up and the shared folder that lineage cuts and trial writes use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def get_spark(app: str = "earnloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators count on; a cluster may override any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where none is named and all runs on one machine a local one is made.

    Remove what a job wrote below ``earnloom/`` in it with the file system's own tools once the job's results
    are stored elsewhere; results that were not stored are read from there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="earnloom-checkpoint-")
    context.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for data that a job writes and reads back."""
    return os.path.join(shared_dir(spark), "earnloom", f"{label}-{uuid.uuid4().hex}")


def pinned(df: DataFrame) -> DataFrame:
    """The rows as written once to the shared folder, so that a retry cannot change or reorder them.

    A Parquet table is written in one pass and read back by column; frames with columns of no type,
    which Parquet does not hold, are checkpointed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return df.checkpoint(eager=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
