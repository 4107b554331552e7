"""Intermediate tables that several branches of a job read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master where none is named."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="esquina-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The branches of a plan that use the result do not compute it again, the planner
    knows its true size, and a lost executor costs no more than the tasks it ran.
    """
    path = f"{shared_dir(df.sparkSession)}/esquina/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides.

    Spark takes a settled table for as large as its files. Rows that compress well are many times that in memory, and
    broadcast they would pass through the driver; this is for tables that grow with the input.
    """
    return df.hint("merge")
