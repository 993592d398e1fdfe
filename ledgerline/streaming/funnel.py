"""The funnel over a stream: state is one row for each (arm, step, session), so it grows with sessions, not events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.funnel import unique_sessions
from ledgerline.storage import fresh


def read_stream(spark: SparkSession, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a batch frame as a stream of the same schema; per_trigger: files in a micro-batch at most."""
    files = like.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    reader = spark.readStream.schema(like.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if len(files) == 1:
        reader = reader.option("pathGlobFilter", files[0].rsplit("/", 1)[1])
    return reader.parquet(folder)


def streamed_funnel(spark: SparkSession, events: DataFrame, steps: list[str]) -> DataFrame:
    """unique_sessions() over everything a stream holds now: (arm, step, session) are kept once by the stream, in update mode, and counted from the table written."""
    out = fresh(spark, "funnel")
    stream = read_stream(spark, events).select((F.col("user_id") % 3).alias("arm"), "event_type", "user_id").dropDuplicates(["arm", "event_type", "user_id"])
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return unique_sessions(spark.read.parquet(f"{out}/rows"), "arm", "event_type", "user_id", steps)


def deduplicated(stream: DataFrame, by: list[str], at: str, exempt: Column, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark, all events where exempt holds. State is dropped as the watermark passes, so it is bounded by the keys of that span."""
    marked = stream.withColumn("__once", F.when(F.coalesce(exempt, F.lit(False)), F.uuid()).otherwise(F.lit("")))
    return marked.withWatermark(at, late).dropDuplicatesWithinWatermark([*by, "__once"]).drop("__once")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream holds now, taken in as many micro-batches as its source makes, as a table."""
    out = fresh(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def live(stream: DataFrame, folder: str, seconds: float = 5.0):
    """A running query that appends a stream to a table every so many seconds; folder/state keeps its place, so another start goes on there."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def run_for(stream: DataFrame, folder: str, seconds: float) -> bool:
    """Takes what a stream holds, for so long at most: True where it came to the end, False where time ran out and the rest is left to the next run. Either way
    the run is logged as a row (expired) in folder/runs."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    query = writer.trigger(availableNow=True).start()
    try:
        ended = bool(query.awaitTermination(seconds))
    finally:
        query.stop()
    stream.sparkSession.createDataFrame([(not ended,)], "expired boolean").coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return ended
