"""Change streams into keyed tables. Every micro-batch writes a new version of the buckets it touches; replaying one changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerline.storage import fresh
from ledgerline.streaming.funnel import read_stream

BUCKETS = 16
BUCKET, NEW = "__bucket", "__new"


class KeyedTable:
    """A keyed table in one folder that outlives the process: rows in hash buckets, each bucket in the version of the last micro-batch that touched it.

    A log names the version of each bucket; it is written after the rows, so a batch that died in between is simply done again. Deleted keys stay
    as marks with their order, so that an older change which comes later cannot bring them back; read() leaves them out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets

    def _log(self) -> dict[int, int]:
        """Bucket: its version; at most `buckets` numbers."""
        try:
            log = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/log")
            return {r.bucket: r.version for r in log.groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        except AnalysisException:
            return {}

    def _rows(self, buckets: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/v{v}/{BUCKET}={b}" for b, v in sorted(buckets.items()) if b >= 0]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The rows that are there now; None before the first micro-batch."""
        rows = self._rows(self._log())
        return None if rows is None else rows.filter(F.col("op") != "delete").drop("op")

    def merge(self, changes: DataFrame, number: int) -> None:
        """changes: key, order columns, op. Of a key the change that is last by order holds, whenever it comes; a delete wins over others of equal order."""
        log = self._log()
        if log.get(-1, -1) >= number:
            return
        dealt = changes.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = {r[0] for r in dealt.select(BUCKET).distinct().collect()}
        stored = self._rows({b: v for b, v in log.items() if b in touched})
        both = dealt.withColumn(NEW, F.lit(1))
        if stored is not None:
            both = both.unionByName(stored.withColumns({BUCKET: F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"), NEW: F.lit(0)}))
        w = Window.partitionBy(self.key).orderBy(*(F.desc(c) for c in self.order), F.when(F.col("op") == "delete", 0).otherwise(1), F.desc(NEW))
        last = both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", NEW)
        last.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/v{number}")
        self.spark.createDataFrame([(b, number) for b in [*touched, -1]], "bucket int, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self._drop({v for b, v in log.items() if b >= 0} - {v for b, v in log.items() if b >= 0 and b not in touched} - {number})

    def _drop(self, versions: set[int]) -> None:
        """Versions of which no bucket is in use any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in versions:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
            old.getFileSystem(conf).delete(old, True)


def streamed_latest(spark: SparkSession, source: DataFrame, key: Column, order: Column, deleted: Column, per_trigger: int = 1) -> DataFrame:
    """k, last: the largest `order` of every key of a batch frame's files, without keys whose last change deletes them, kept by a stream of micro-batches of so many files."""
    out = fresh(spark, "merge")
    table = KeyedTable(spark, f"{out}/table", "k", ["last"])
    changes = read_stream(spark, source, per_trigger).select(key.alias("k"), order.alias("last"), F.when(deleted, "delete").otherwise("update").alias("op"))
    run = changes.writeStream.foreachBatch(lambda df, n: table.merge(df, n)).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()
