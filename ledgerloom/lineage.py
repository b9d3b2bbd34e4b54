"""Cutting lineage where a result is read more than once: tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session of this machine alone may do without; on a cluster the setting is needed.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "spark-warehouse/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table of the shared folder and read back: it survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # The schema is given, so that an empty table and all-null columns read back alike.
    return df.sparkSession.read.schema(df.schema).parquet(path)
