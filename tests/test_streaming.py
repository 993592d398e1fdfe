"""Streams that run for a while, and go on where they stopped."""

import time

from pyspark.sql import functions as F

from ledgerline.streaming import funnel


def files(spark, path, n):
    spark.range(n * 10).repartition(n).write.parquet(path)
    return funnel.read_stream(spark, spark.read.parquet(path), per_trigger=1)


def test_live_streams_go_on_where_they_stopped(spark, tmp_path):
    stream, out = files(spark, f"file://{tmp_path}/in", 4), f"file://{tmp_path}/out"
    query = funnel.live(stream, out, 0.2)
    while not query.recentProgress:
        time.sleep(0.1)
    query.stop()
    assert funnel.run_for(stream, out, 120)
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == 40 == got.distinct().count()


def test_a_run_that_expires_is_logged(spark, tmp_path):
    slow = files(spark, f"file://{tmp_path}/in", 3).select(F.udf(lambda x: (time.sleep(0.3), x)[1], "long")("id").alias("id"))
    out = f"file://{tmp_path}/out"
    assert not funnel.run_for(slow, out, 0.5)
    assert funnel.run_for(slow, out, 300)
    assert sorted(r.expired for r in spark.read.parquet(f"{out}/runs").collect()) == [False, True]
    assert spark.read.parquet(f"{out}/rows").distinct().count() == 30


def test_first_events_within_the_watermark(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    rows = [("s1", "E2", 0), ("s1", "E2", 1), ("s1", "E7", 2), ("s1", "E7", 3), ("s2", "E2", 4)]
    spark.createDataFrame(rows, "sid string, event string, s long").select("sid", "event", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(path)
    stream = funnel.read_stream(spark, spark.read.parquet(path))
    got = funnel.run_once(funnel.deduplicated(stream, ["sid", "event"], "at", F.col("event") == "E7"), "first")
    assert sorted((r.sid, r.event) for r in got.collect()) == [("s1", "E2"), ("s1", "E7"), ("s1", "E7"), ("s2", "E2")]
