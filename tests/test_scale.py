"""Ranks, medians and keyed tables where one task or one process would not do."""

import random
from statistics import median

from pyspark.sql import functions as F

from ledgerline.operators import funnel, incremental, memory, policy, quality, ranking, verdicts
from ledgerline.streaming.merge import KeyedTable


def test_batch_numbers_with_other_columns(spark):
    rows = spark.range(3_000_000).select((F.col("id") * 7 % 3_000_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = incremental.batch_numbers(rows, "k", 200)
    assert got.columns == ["k", "payload", "batch"]
    assert got.filter(F.col("batch") != F.floor(F.col("k") / 200)).count() == 0 and got.count() == 3_000_000


def test_medians_equal_plain_ones(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 9), r.random()])) for _ in range(3000)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    want = {g: median(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None, "d")}
    assert {x.g: x["median"] for x in ranking.medians(df, ["g"], "v").collect()} == want
    assert ranking.medians(df, [], "v").first()["median"] == median(v for _, v in rows if v is not None)
    assert ranking.medians(df.limit(0), ["g"], "v").count() == 0 and ranking.medians(df.limit(0), [], "v").first()["median"] is None


def test_keyed_table_outlives_the_process_and_keeps_order(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    of = lambda rows: spark.createDataFrame(rows, "k long, seq long, op string, v string")
    table = lambda: KeyedTable(spark, path, "k", ["seq"], buckets=3)
    assert table().read() is None
    table().merge(of([(1, 10, "insert", "a"), (2, 1, "insert", "b"), (3, 1, "insert", "c")]), 0)
    table().merge(of([(1, 5, "update", "old"), (3, 2, "delete", None)]), 1)
    table().merge(of([(3, 1, "update", "late"), (4, 1, "insert", "d")]), 2)
    table().merge(of([(2, 9, "delete", None)]), 1)  # a replayed batch
    now = {(r.k, r.seq, r.v) for r in table().read().collect()}
    assert now == {(1, 10, "a"), (2, 1, "b"), (4, 1, "d")}
    table().merge(of([(3, 3, "insert", "again"), (2, 1, "delete", None)]), 3)
    assert {(r.k, r.v) for r in table().read().collect()} == {(1, "a"), (3, "again"), (4, "d")}


def test_index_assets_and_counters(spark):
    rows = [(1, True, False, 100, 100, 0.0), (2, False, True, 0, 0, 0.0), (3, False, False, 10, 10, 0.1), (4, None, False, 100, 200, 0.0)]
    df = spark.createDataFrame(rows, "id int, missing boolean, screenshot boolean, width int, height int, score double")
    got = memory.index_assets(df, lambda x: x.withColumn("cost", F.lit(4.0)))
    assert {r.id: (r.reason, r.attempted, r.failed, r.cost) for r in got.collect()} == {1: ("missing", False, True, None), 2: ("screenshot-subtype", True, False, 4.0), 3: ("gated-out", False, False, None), 4: ("screen-aspect", True, False, 4.0)}
    assert tuple(memory.stage_counters(got, "cost").first()) == (4, 2, 1, 1, 4.0)
    assert memory.stage_counters(got.filter("id = 3"), "cost").first().cost_per_attempt == 0.0


def test_duplicates_need_a_second_signal(spark):
    rows = [(1, 5, 10), (2, 5, 10), (3, 5, 11), (4, 0, 10), (5, 0, 10), (6, None, 10), (7, None, 10), (8, 5, None)]
    got = memory.skip_duplicates(spark.createDataFrame(rows, "id int, h long, size int"), "id", "h", "size").collect()
    assert {r.id: r.linked_to for r in got} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}
    hashes = spark.createDataFrame([(0,), (1,), (3,), (-1,), (-2,), (1 << 40,)], "h long")
    assert {(r.a, r.b, r.distance) for r in memory.near_hashes(hashes, "h", 2).collect()} == {(1, 3, 1), (1, 1 << 40, 2), (-2, -1, 1)}


def test_gates_and_policies(spark):
    counts = spark.createDataFrame([("a", 400, 100, 20, 15), ("b", 500, 100, 10, 9), ("c", 450, 50, 9, 4)], "arm string, e2 long, e4 long, e5 long, e7 long")
    one = policy.funnel_verdict(counts, "arm", "c", "e2", "e4", "e5", "e7").first()
    assert (one.arm, one.p1, one.p2, one.p3, one.p4, one.verdict) == ("a", "PASS", "PASS", "PASS", "PASS", "PASS")
    assert policy.funnel_verdict(counts, "arm", "a", "e2", "e4", "e5", "e7").first().verdict == "FAIL"
    assert policy.funnel_verdict(counts, "arm", "a", "e2", "e4", "e5", "e7", least=401).first().verdict == "INCOMPLETE"
    assert policy.funnel_verdict(counts.limit(0), "arm", "a", "e2", "e4", "e5", "e7").first().verdict == "INCOMPLETE"
    assets = spark.createDataFrame([(1, "R5", 1.0, True), (2, "R1", 0.95, True), (3, "R9", 0.1, False)], "id int, risk string, confidence double, recoverable boolean")
    table = policy.rules(spark, [(1, None, 0.9, True, "Auto-Clean")])
    assert {r.id: r.action for r in policy.act(assets, table, "id").collect()} == {1: "Protect", 2: "Auto-Clean", 3: "Review"}


def test_tallies_gates_and_statements(spark):
    none = spark.createDataFrame([], "status string, category string")
    assert quality.tallies(none).first().status == "WARN"
    try:
        quality.gated(spark.range(1), spark.createDataFrame([("x", "OK"), ("y", "FAIL")], "name string, status string"))
        raise AssertionError("rows must not pass a failed check")
    except ValueError as e:
        assert "y" in str(e)
    devices = spark.createDataFrame([("d1", 2, False, ["A1", "A3"]), ("d2", 4, True, [])], "device_model string, rank int, supported boolean, blocked_by array<string>")
    said = lambda df: tuple(verdicts.minimum_statement(df).first())
    assert said(devices) == ("MEASURED", "d2", None, False)
    assert said(devices.filter("rank = 4"))[0] == "OLDEST AVAILABLE" and said(devices.filter("rank = 2")) == ("NO DEVICE PASSES", None, "A1,A3", True)
    assert said(devices.limit(0))[0] == "NO DATA"


def test_rota_is_balanced_whatever_the_keys(spark):
    got = funnel.rota(spark.range(40).select((F.col("id") * F.col("id")).alias("k")), "k").groupBy("arm_order", "variant").count().collect()
    assert {(r.arm_order, r.variant): r["count"] for r in got} == {(0, 0): 10, (1, 1): 10, (0, 2): 10, (1, 3): 10}


def test_work_can_be_cancelled(spark):
    import threading

    failed = []

    def run():
        try:
            memory.cancellable(spark, "slow", lambda: spark.range(0, 8, 1, 8).rdd.map(lambda x: __import__("time").sleep(30)).count())
        except Exception as e:
            failed.append(e)

    worker = threading.Thread(target=run)
    worker.start()
    for _ in range(100):
        worker.join(0.2)
        spark.sparkContext.cancelJobGroup("slow")
        if not worker.is_alive():
            break
    worker.join(30)
    assert failed and not worker.is_alive()
