from pyspark.sql import functions as F

from ledgerline.operators import funnel, hierarchy, incremental, quality, verdicts
from ledgerline.sources import files


def run(model, kind, wall, n, **more):
    base = dict.fromkeys(["chip", "delta_source", "thermal_serious_s", "thermal_critical_s", "assets_reprocessed_after_resume", "delta_inserted", "delta_updated", "index_bytes_per_asset", "battery_drain_pct_per_10k", "first_screen_stall_ms", "resumed_ok", "index_state_recovered_after_kill", "required_full_rescan"])
    return {**base, "device_model": model, "run_type": kind, "wall_time_s": str(wall), "assets_indexed": str(n), **{k: str(v) for k, v in more.items()}}


def judged(spark, rows):
    names = list(rows[0])
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    return verdicts.device_verdicts(verdicts.run_rows(raw))


GOOD = [
    run("iPhone14,5", "cold", 4200, 100_000, thermal_serious_s=20, index_bytes_per_asset=1500, battery_drain_pct_per_10k=2.6, first_screen_stall_ms=1800),
    run("iPhone14,5", "resume", 900, 20_000, resumed_ok="true", assets_reprocessed_after_resume=180, index_state_recovered_after_kill="true"),
    run("iPhone14,5", "incremental", 14, 120, delta_source="persistent-token", delta_updated=3, delta_inserted=100),
]
WEAK = [
    run("iPhone11,8", "cold", 3100, 30_000, thermal_serious_s=900, thermal_critical_s=100, index_bytes_per_asset=1733, battery_drain_pct_per_10k=10.7, first_screen_stall_ms=4200),
    run("iPhone11,8", "incremental", 40, 100, required_full_rescan="true", delta_updated=1),
]


def test_device_verdicts(spark):
    got = {r.device_model: r for r in judged(spark, GOOD + WEAK).collect()}
    a, b = got["iPhone14,5"], got["iPhone11,8"]
    assert [a[c] for c in verdicts.CRITERIA] == ["PASS"] * 4 and a.supported and a.chip == "A15" and a["rank"] == 5
    assert round(a.serious_share, 4) == 0.0039 and round(a.delta_s_per_100, 2) == 11.67 and a.index_ok and a.battery_ok and a.stall_ok
    assert [b[c] for c in verdicts.CRITERIA] == ["FAIL", "FAIL", "NO DATA", "FAIL"] and b.a1_projected and round(b.projected_s / 60, 1) == 172.2
    assert b.blocked_by == ["A1", "A2", "A3", "A4"] and not b.supported and not b.battery_ok and not b.stall_ok and b.index_ok
    low = verdicts.minimum_supported(judged(spark, GOOD + WEAK)).first()
    assert low.minimum == "iPhone14,5" and low.older_failed == 1


def test_evidence_states(spark):
    short = [run("iPhone15,1", "cold", 100, 30_000), run("iPhone15,1", "incremental", 1, 100)]
    got = judged(spark, short).first()
    assert got.A1 == "PROJECTION" and got.A3 == "NO DATA" and got.A4 == "NO DATA" and not got.supported
    edge = judged(spark, [run("x", "cold", 5400, 95_000, thermal_serious_s=270), run("x", "resume", 0, 0, assets_reprocessed_after_resume=200)]).first()
    assert edge.A1 == "PASS" and edge.A2 == "FAIL" and edge.A3 == "PASS" and edge["rank"] == -1
    none = verdicts.minimum_supported(judged(spark, short)).first()
    assert none.minimum is None and none.older_failed == 0


def test_paired_wins_and_study(spark):
    rows = [("p1", "T1", "b", "10", "2"), ("p1", "T1", "", "20", "3"), ("p1", "T2", "proto", "10", "2"), ("p2", "T1", "b", "999", "9")]
    tasks = spark.createDataFrame(rows, "pid string, task string, arm string, time_s string, steps string")
    people = spark.createDataFrame([("p1", "y", "Prototype", " structural", "structural ", "yes", "no", "y"), ("p2", None, "b", "", "", "", "", "")], "pid string, fair_config_ok string, forced_choice string, reason_code_c1 string, reason_code_c2 string, passport_pred_proto_level1 string, passport_pred_proto_full string, org_vocab_proto string")
    got = verdicts.study_b(people, tasks, ["T1", "T2", "T3"])
    assert {r.task: r.verdict for r in got["wins"].collect()} == {"T1": "PASS", "T2": "NO DATA", "T3": "NO DATA"}
    assert {r.criterion: (r.k, r.n) for r in got["criteria"].collect()} == {"P-1": (1, 1), "P-2": (1, 1), "P-5a": (1, 1), "P-5b": (0, 1), "P-6": (1, 1)}
    assert got["pilots"].count() == 1
    verdict = got["verdict"].first()
    assert (verdict.n, verdict.p1, verdict.p2, verdict.p3, verdict.verdict) == (1, "PASS", "PASS", "FAIL", "INCOMPLETE")


def test_study_d(spark):
    names = ["pid", "ledger_variant", "mode_choice", "ledger_comprehension_s", "identified_work_done", *verdicts.TOLERANCES, "recoverability_changed", "queue_crossover"]
    row = lambda i: (f"p{i}", "V1" if i < 6 else "v4 ", "3" if i < 4 else "2" if i < 9 else "1", "12" if i < 8 else "", "yes" if i < 8 else "n", "auto", "AUTO" if i < 9 else "ask", *["ask"] * 5, "never", "never", "y" if i < 7 else "", str(60 + 5 * i) if i < 9 else "0")
    got = verdicts.study_d(spark.createDataFrame([row(i) for i in range(10)], ", ".join(f"{n} string" for n in names)))
    table = {r.criterion: (r.k, r.verdict, r.inconclusive) for r in got["criteria"].collect()}
    assert table == {"D-P1": (9, "PASS", True), "D-P2": (4, "PASS", True), "D-P3": (8, "PASS", True), "D-P4": (8, "PASS", True), "D-P5a": (10, "PASS", True), "D-P5b": (9, "PASS", True), "D-P6": (7, "PASS", True)}
    low = got["gradient"].first()
    assert round(low.low_risk, 2) == 0.95 and low.high_risk == 0 and low.gradient == "GRADED"
    assert got["burden"].first().per_1000 == 8.0 and got["verdict"].first().verdict == "INCOMPLETE"
    assert {r.variant: (r.n, r.autonomous) for r in got["variants"].collect()} == {"V1": (6, 4), "V2": (0, 0), "V3": (0, 0), "V4": (4, 0)}
    assert {r.content: (r.auto, r.ask, r.never) for r in got["answers"].collect()}["tol_meme"] == (9, 1, 0)


def test_overall_and_gradient(spark):
    of = lambda n, a, b: spark.range(1).select(verdicts.overall(F.lit(n), F.lit(a), F.lit(b)).alias("v")).first().v
    assert [of(14, "PASS", "PASS"), of(15, "PASS", "PASS"), of(15, "PASS", "FAIL"), of(15, "FAIL", "PASS")] == ["INCOMPLETE", "PASS", "GO WITH CONSTRAINTS", "FAIL"]
    df = spark.createDataFrame([("auto", "Auto", "ask", "never")] * 3, "a string, b string, c string, d string")
    assert verdicts.gradient(df, list("abcd")).first().gradient == "GRADED"
    assert verdicts.gradient(df.limit(0), list("abcd")).first().gradient == "NO DATA"


TREE = {"Docs": {"_icon": "d", "IDs": {"_also_in": ["Travel"]}, "Bills": {}}, "Travel": {"Lisbon": {}}}


def test_tree_and_roll_up(spark):
    nodes = hierarchy.flatten_tree(spark, TREE)
    assert [(r.path, r.is_leaf) for r in nodes.orderBy("ordinal").collect()] == [("Docs", False), ("Docs > IDs", True), ("Docs > Bills", True), ("Travel", False), ("Travel > Lisbon", True)]
    assets = spark.createDataFrame([(1, ["Docs > IDs", "Docs > Bills"]), (2, ["Docs > IDs", "Nowhere"]), (3, [])], "id long, paths array<string>")
    index = hierarchy.entries(assets, "id", "paths")
    got = {r.path: (r.assets, r.entries) for r in hierarchy.roll_up(index, "id", nodes.select("path")).collect()}
    assert got == {"Docs": (2, 3), "Docs > IDs": (2, 2), "Docs > Bills": (1, 1), "Travel": (0, 0), "Travel > Lisbon": (0, 0)}
    assert [tuple(r) for r in hierarchy.invalid_paths(index, nodes.filter("is_leaf")).collect()] == [("Nowhere", 1)]
    view = hierarchy.leaf_view(index, [F.desc("id")], 1)
    assert {(r.path, r.id, r.more) for r in view.collect()} == {("Docs > IDs", 2, 1), ("Docs > Bills", 1, 0), ("Nowhere", 2, 0)}
    targets = spark.createDataFrame([("Docs > IDs", 2), ("Docs > IDs", 1)], "path string, id long")
    assert [r.id for r in hierarchy.unreachable(targets, view, "id").collect()] == [1]


def test_generated_library(spark):
    a = hierarchy.generate_library(spark, 200, {"Docs > IDs": 0.5, "Docs > Bills": 0.001, "Travel > Lisbon": 0.6})
    assert a.count() == 200 and a.exceptAll(hierarchy.generate_library(spark, 200, {"Docs > IDs": 0.5, "Docs > Bills": 0.001, "Travel > Lisbon": 0.6})).count() == 0
    assert {r["primary"]: r["count"] for r in a.groupBy("primary").count().collect()} == {"Docs > IDs": 100, "Docs > Bills": 1, "Travel > Lisbon": 99}


def test_groups_overlap(spark):
    df = spark.createDataFrame([(1, "e1", "m1"), (2, "e1", None), (3, None, "m1")], "id long, entity string, moment string")
    got = {(r.kind, r.name): r.members for r in hierarchy.group_members(df, "id", ["entity", "moment"]).collect()}
    assert got == {("entity", "e1"): [1, 2], ("moment", "m1"): [1, 3]}


def test_delta_is_idempotent_and_delete_wins(spark):
    index = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    now = spark.createDataFrame([(2, "B"), (4, "D"), (5, "E")], "k long, v string")
    changes = spark.createDataFrame([(2, "update"), (4, "insert"), (9, "insert"), (5, "insert"), (5, "delete"), (1, "delete")], "k long, op string")
    once = incremental.apply_delta(index, changes, now, "k")
    assert sorted(map(tuple, once.collect())) == [(2, "B"), (3, "c"), (4, "D")]
    assert sorted(map(tuple, incremental.apply_delta(once, changes, now, "k").collect())) == [(2, "B"), (3, "c"), (4, "D")]


def test_owned_delete_batches_and_latest(spark):
    index, owned = spark.range(6).withColumnRenamed("id", "k"), spark.createDataFrame([(1,), (2,)], "k long")
    assert sorted(r.k for r in incremental.owned_delete(index, index, owned, "k").collect()) == [0, 3, 4, 5]
    got = incremental.batch_numbers(spark.range(1000).selectExpr("id * 3 as k"), "k", 200).groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("batch").collect()
    assert [(r.batch, r.n, r.a) for r in got] == [(i, 200, 600 * i) for i in range(5)]
    log = spark.createDataFrame([(1, 1, "insert"), (1, 2, "update"), (1, 2, "delete"), (2, 1, "insert")], "k long, seq long, op string")
    assert {(r.k, r.op) for r in incremental.latest(log, "k", ["seq"]).collect()} == {(1, "delete"), (2, "insert")}


def test_funnel(spark):
    events = spark.createDataFrame([("a", "s1", "E2"), ("a", "s1", "E2"), ("a", None, "E2"), ("a", "s2", "E5"), ("b", "s3", "E5"), (None, "s", "E2")], "arm string, sid string, event string")
    got = {r.arm: (r.E2, r.E5, r.E7) for r in funnel.unique_sessions(events, "arm", "event", "sid", ["E2", "E5", "E7"]).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 0)}
    known = funnel.unique_sessions(events, "arm", "event", "sid", ["E2"], count_unknown=True)
    assert {r.arm: r.E2 for r in known.collect()} == {"a": 2, "b": 0}
    rates = funnel.rates(funnel.unique_sessions(events, "arm", "event", "sid", ["E2", "E5", "E7"]), {"buy": ("E5", "E2"), "pay": ("E7", "E5")}, "E2").collect()
    assert [(r.arm, r.buy, r.pay) for r in rates] == [("a", 100.0, 0.0)]


def test_dwell_and_private_split(spark):
    rows = spark.createDataFrame([("r", 0, "fair"), ("r", 5, "serious"), ("r", 12, "fair")], "run string, s long, state string").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.state: r.seconds for r in funnel.dwell(rows, ["run"], "ts", "state", close=F.timestamp_seconds(F.lit(20))).collect()} == {"fair": 13.0, "serious": 7.0}
    public, private = funnel.split_private(spark.createDataFrame([("a", "x@y"), ("b", None)], "sid string, email string"), "email")
    assert "email" not in public.columns and public.filter("captured").count() == 1 and private.count() == 1


def test_quality(spark):
    checks = spark.createDataFrame([("OK", "b"), ("FAIL", "z"), ("WARN", "a"), ("FAIL", "c")], "status string, category string")
    assert [tuple(r) for r in quality.ranked(checks).collect()] == [("FAIL", "c"), ("FAIL", "z"), ("WARN", "a"), ("OK", "b")]
    of = lambda a, b: spark.range(1).select(quality.status_of(F.lit(a), F.lit(b)).alias("s")).first().s
    assert (of(0, 0), of(3, 1), of(3, 0)) == ("WARN", "FAIL", "OK")
    assert quality.header_parity(["a", "c"], ["a", "b"]) == {"equal": False, "missing": ["b"], "unexpected": ["c"]}
    bad = quality.shifted(spark.createDataFrame([("iPhone14",), ("iPhone14,5",), ("iPad",)], "device_model string"), "device_model", "iphone")
    assert [r.device_model for r in bad.collect()] == ["iPhone14"]
    a = spark.createDataFrame([(1, "x", "t1"), (2, None, "t"), (3, "y", "t")], "k long, v string, at string")
    b = spark.createDataFrame([(1, "x", "t2"), (2, "n", "t"), (4, "z", "t")], "k long, v string, at string")
    got = {r.k: (r.status, r.columns) for r in quality.compare(a, b, "k", volatile=("at",)).collect()}
    assert got == {1: ("same", []), 2: ("changed", ["v"]), 3: ("removed", []), 4: ("added", [])}
    refs = spark.createDataFrame([("docs/a.md",), ("a.md",), ("gone.md",)], "target string")
    known = spark.createDataFrame([("docs/a.md",)], "path string")
    assert {r.target: r.resolved for r in quality.resolve(refs, known).collect()} == {"docs/a.md": True, "a.md": True, "gone.md": False}
    assert quality.all_equal(refs.limit(0), F.col("target")).first().equal is False
    ask = spark.createDataFrame([("the plan and the owner",)], "t string")
    assert ask.select(quality.answerable(F.col("t"), ["plan", "own.r"]).alias("a"), quality.answerable(F.col("t"), ["plan", "date"]).alias("b")).first() == (True, False)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('m,n,notes\n"iPhone14,5",1,"say ""hi""\nthere"\nx,,\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["m", "n", "notes"]).collect()
    assert [tuple(r) for r in rows] == [("iPhone14,5", "1", 'say "hi"\nthere'), ("x", None, None)]
    try:
        files.read_csv(spark, str(tmp_path / "a.csv"), ["m", "notes", "n"])
        raise AssertionError("an unexpected header must not pass")
    except ValueError as e:
        assert "SCHEMA MISMATCH" in str(e)
    (tmp_path / "b.csv").write_text('a,b,c\n1,"2,2",3\n1,2\n')
    assert [r.cells for r in files.wrong_width(spark, str(tmp_path / "b.csv"), 3).collect()] == [2]
    (tmp_path / "e.jsonl").write_text('{"sid":"s","event":"E2"}\n\n{broken\n')
    assert files.read_lines(spark, str(tmp_path / "e.jsonl"), "sid string, event string").count() == 1
    (tmp_path / "p.json").write_text('{"x": [["Pro", "$39.99"], ["Year", "$1,000.00"]], "y": ["NO IAP BLOCK"]}')
    assert {(r.app, r.label, None if r.price is None else float(r.price)) for r in files.read_pairs(spark, str(tmp_path / "p.json")).collect()} == {("x", "Pro", 39.99), ("x", "Year", 1000.0), ("y", "NO IAP BLOCK", None)}
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p>three</w:p>")
    (tmp_path / "bad.docx").write_text("no")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()} == {"d.docx": "One & two\nthree", "bad.docx": None}
    assert files.csv_rows(spark, "a,b\n1\n2,3,4").collect() == [("1", None), ("2", "3")]
    assert {r.name for r in files.file_index(spark, str(tmp_path)).collect()} >= {"a.csv", "d.docx"}


def test_required_files_tells_pages_of_one_url_apart(spark, tmp_path):
    from ledgerline.plans import registry

    pages = [(10, "u"), (11, "u"), (12, "v"), (20, "w"), (None, "x"), (13, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, registry.QUERIES["required_files"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("u", "FAIL"), ("u", "OK"), ("v", "OK"), ("w", "FAIL"), ("x", "OK"), (None, "OK"), ("README.md", "FAIL")], key=repr)
