"""Where tables that cut lineage, streams and round trips are kept: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "file:///tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or FALLBACK).rstrip('/')}/ledgerline-streams-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path below scratch() that nothing uses yet."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that jobs which read it several times see the same rows in the same partitions."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has kept; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
