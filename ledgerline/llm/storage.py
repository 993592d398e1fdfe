"""Reading the input tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "file:///tmp/checkpoints"
#: Column of numbered(): no table of ours has it.
RID = "__rid"
FILE, BLOCK = "__file", "__block"
#: Spark's setting for deleting a query's shuffle files when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seeds tried for a hash that tells the files apart.
SEEDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or FALLBACK).rstrip('/')}/ledgerline-{spark.sparkContext.applicationId}"


def _written(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later stages survive lost executors without redoing it."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name))


@contextmanager
def tidy(spark: SparkSession):
    """Queries that run within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Passing:
    """Tables saved for a while: their shuffle files go when they are written, they themselves at drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        with tidy(self.spark):
            self.paths.append(_written(df, name))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Deletes them; nothing that is run later may read them."""
        while self.paths:
            _delete(self.spark, self.paths.pop())


def _plain_scan(df: DataFrame) -> bool:
    try:
        todo, plain = [df._jdf.queryExecution().optimizedPlan()], {"Project", "Filter", "LogicalRelation"}
    except AttributeError:  # a session without a JVM at hand
        return False
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in plain:
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def settled(df: DataFrame, name: str) -> DataFrame:
    """df if it is a plain scan, which costs nothing to read again; else a saved copy."""
    return df if _plain_scan(df) else saved(df, name)


def _with_places(df: DataFrame, name: str, order: list | None = None) -> tuple[DataFrame, object]:
    """(df or a written copy of it, its column of metadata)."""
    if not _plain_scan(df) or "_metadata" in df.columns:
        df = saved(df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    try:
        return df, df.metadataColumn("_metadata")
    except Exception:  # a table whose reader has no such column
        df = saved(df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order), name)
        return df, df.metadataColumn("_metadata")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column RID that tells rows apart: made of a hash of the row's file and its place there, so it is the same
    however often, by however many tasks and in whatever splits the rows are read. What is no plain scan of files is written first.

    One small job reads no column: the hash's seed is one under which no two files meet.
    """
    df, meta = _with_places(df, name)
    file, row = meta.getField("file_path"), meta.getField("row_index")
    files = saved(df.select(file.alias("f"), row.alias("r")).groupBy("f").agg(F.max("r").alias("r")), "files")
    n, most = files.agg(F.count("*"), F.max("r")).first()
    shift = int(most or 0).bit_length()
    hashed = lambda f, seed: F.shiftleft(F.xxhash64(f, F.lit(seed)), shift)
    kinds = list(files.agg(*(F.count_distinct(hashed("f", seed)) for seed in range(SEEDS))).first())
    if n not in kinds:
        raise ValueError(f"no seed tells {n} files of up to 2**{shift} rows apart: write them as fewer files")
    return df.select("*", hashed(file, kinds.index(n)).bitwiseOR(row).alias(RID))


def in_splits(df: DataFrame, name: str, order: list) -> DataFrame:
    """df with FILE and BLOCK, the path and the first byte of the split that a row is read from: rows in order of path, split and place there
    are in one order however they are read. What is no plain scan of files is written first, in the order given."""
    df, meta = _with_places(df, name, order)
    return df.select("*", meta.getField("file_path").alias(FILE), meta.getField("file_block_start").alias(BLOCK))


def clear(spark: SparkSession) -> None:
    """Deletes what saved() has written for this application; call it when no result is read any more."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
