"""Verdicts from evidence: PASS, FAIL, NO DATA, and PROJECTION, which is never a pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import coerce, signals, stats
from ledgerline.operators import ranking


@dataclass(frozen=True)
class Budgets:
    """The pre-registered budgets."""

    cold_s: float = 5400
    measured_at: int = 95_000
    serious_share: float = 0.05
    critical_s: float = 0
    reprocessed: int = 200
    delta_s_per_100: float = 60
    index_bytes: float = 2048
    battery_pct: float = 8
    stall_ms: float = 3000


# Chips from oldest to newest, and the chip of each device family.
CHIPS = ["A10", "A11", "A12", "A13", "A14", "A15", "A16", "A17", "A18", "A19"]
FAMILIES = {"iPhone9": "A10", "iPhone10": "A11", "iPhone11": "A12", "iPhone12": "A13", "iPhone13": "A14", "iPhone14": "A15", "iPhone15": "A16", "iPhone16": "A17", "iPhone17": "A18", "iPhone18": "A19"}
CRITERIA = ("A1", "A2", "A3", "A4")


def run_rows(raw: DataFrame) -> DataFrame:
    """Typed measures of all-text benchmark rows."""
    numbers = ["wall_time_s", "assets_indexed", "thermal_serious_s", "thermal_critical_s", "assets_reprocessed_after_resume", "delta_inserted", "delta_updated", "index_bytes_per_asset", "battery_drain_pct_per_10k", "first_screen_stall_ms"]
    flags = ["resumed_ok", "index_state_recovered_after_kill", "required_full_rescan"]
    columns = set(raw.columns)
    have = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    return raw.select("device_model", "run_type", have("chip").alias("chip"), have("delta_source").alias("delta_source"), *(coerce.number(have(c)).alias(c) for c in numbers), *(coerce.truthy(have(c)).alias(c) for c in flags))


def device_verdicts(runs: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """One row a device: A1-A4, their measures, supporting budgets, supported and blocked_by. One shuffle."""
    b = budgets
    cold = F.col("run_type").isin("cold", "resume")
    scale = cold & (F.floor("assets_indexed") >= b.measured_at)
    resumed = (F.col("run_type") == "resume") | F.col("resumed_ok")
    delta = F.col("run_type") == "incremental"
    per_100 = F.when(delta & (F.col("assets_indexed") > 0), F.col("wall_time_s") * 100 / F.when(F.col("assets_indexed") > 0, F.col("assets_indexed")))
    usable = cold & (F.floor("assets_indexed") > 0) & (F.col("wall_time_s") > 0)
    rate = F.median(F.when(usable, F.floor("assets_indexed") / F.when(F.col("wall_time_s") > 0, F.col("wall_time_s"))))
    positive = lambda c, where=F.lit(True): F.max(F.when(where & (F.col(c) > 0), F.col(c)))
    got = runs.groupBy("device_model").agg(
        signals.chip(F.first("chip", True), F.first("device_model"), FAMILIES).alias("chip"),
        F.max(F.when(scale, F.col("wall_time_s"))).alias("worst_s"), F.try_divide(F.lit(100_000.0), rate).alias("projected_s"), F.count_if(cold).alias("cold_runs"),
        F.sum(F.when(cold, F.col("wall_time_s"))).alias("wall_s"), F.sum(F.when(cold, F.col("thermal_serious_s"))).alias("serious_s"), F.sum(F.when(cold, F.col("thermal_critical_s"))).alias("critical_s"),
        F.count_if(resumed).alias("resumes"), F.max(F.when(resumed, F.col("assets_reprocessed_after_resume"))).alias("reprocessed"), F.bool_or(F.when(resumed, F.col("index_state_recovered_after_kill"))).alias("recovered"),
        F.count_if(delta).alias("deltas"), F.count_if(delta & F.col("required_full_rescan")).alias("rescans"), F.max(per_100).alias("delta_s_per_100"), F.coalesce(F.bool_or(delta & (F.col("delta_updated") >= 1)), F.lit(False)).alias("saw_update"),
        F.sort_array(F.collect_set(F.when(delta & (F.col("delta_source") != ""), F.col("delta_source")))).alias("delta_sources"),
        positive("index_bytes_per_asset", cold).alias("index_bytes"), positive("battery_drain_pct_per_10k", cold).alias("battery_pct"), positive("first_screen_stall_ms").alias("stall_ms"),
    )
    share = F.col("serious_s") / F.when(F.col("wall_s") == 0, 1.0).otherwise(F.col("wall_s"))
    verdict = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    a1 = F.when(F.col("worst_s").isNotNull(), verdict(F.col("worst_s") <= b.cold_s)).when(F.col("projected_s").isNull(), "NO DATA").when(F.col("projected_s") > b.cold_s, "FAIL").otherwise("PROJECTION")
    a2 = F.when(F.col("cold_runs") == 0, "NO DATA").otherwise(verdict((F.col("critical_s") <= b.critical_s) & (F.col("serious_share") < b.serious_share)))
    a3 = F.when(F.col("resumes") == 0, "NO DATA").otherwise(verdict(F.col("reprocessed") <= b.reprocessed))
    a4 = F.when(F.col("deltas") == 0, "NO DATA").when(F.col("rescans") > 0, "FAIL").when(F.col("delta_s_per_100") > b.delta_s_per_100, "FAIL").when(~F.col("saw_update"), "NO DATA").otherwise("PASS")
    judged = got.withColumn("serious_share", share).withColumns({"A1": a1, "A2": a2, "A3": a3, "A4": a4, "rank": signals.rank(CHIPS, F.col("chip"))})
    judged = judged.withColumns({"index_ok": F.col("index_bytes") <= b.index_bytes, "battery_ok": F.col("battery_pct") <= b.battery_pct, "stall_ok": F.col("stall_ms") <= b.stall_ms, "a1_projected": F.col("worst_s").isNull() & F.col("projected_s").isNotNull()})
    return judged.withColumn("blocked_by", failed_of(CRITERIA)).withColumn("supported", F.size("blocked_by") == 0)


def failed_of(names: tuple[str, ...]) -> Column:
    """Names of the criteria that are not PASS."""
    return F.array_compact(F.array(*(F.when(F.col(c) != "PASS", F.lit(c)) for c in names)))


def minimum_supported(devices: DataFrame) -> DataFrame:
    """One row: the oldest supported device of known rank, how many older ones failed, what blocked any device."""
    known = F.col("supported") & (F.col("rank") >= 0)
    oldest = devices.agg(F.min_by(F.when(known, F.col("device_model")), F.when(known, F.struct("rank", "device_model"))).alias("minimum"), F.min(F.when(known, F.col("rank"))).alias("minimum_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocked_by")))).alias("blocked_by"))
    older = devices.join(F.broadcast(oldest.select("minimum_rank")), (F.col("rank") >= 0) & (F.col("rank") < F.col("minimum_rank"))).agg(F.count("*").alias("older_failed"))
    return oldest.crossJoin(F.broadcast(older))  # one row each


def minimum_statement(devices: DataFrame) -> DataFrame:
    """One row: what may be said of the minimum: NO DATA without a device of known rank, NO DEVICE PASSES with what blocks them, else the oldest that passes,
    MEASURED where an older one was tested and failed and OLDEST AVAILABLE where none was. An A3 failure among the blocks is fatal."""
    known = F.col("rank") >= 0
    passing = known & F.col("supported")
    oldest = devices.agg(F.count_if(known).alias("ranked"), F.min_by(F.when(passing, F.col("device_model")), F.when(passing, F.struct("rank", "device_model"))).alias("minimum"), F.min(F.when(passing, F.col("rank"))).alias("at"), F.min(F.when(known, F.col("rank"))).alias("oldest_tested"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(known, F.col("blocked_by")))))).alias("blocked"))
    said = F.when(F.col("ranked") == 0, "NO DATA").when(F.col("minimum").isNull(), "NO DEVICE PASSES").when(F.col("oldest_tested") < F.col("at"), "MEASURED").otherwise("OLDEST AVAILABLE")
    blocked = F.when(F.col("minimum").isNull(), F.array_join("blocked", ","))
    return oldest.select(said.alias("statement"), "minimum", blocked.alias("blocked_by"), (F.col("minimum").isNull() & F.array_contains("blocked", "A3")).alias("fatal"))


def ordered_devices(devices: DataFrame) -> DataFrame:
    """Oldest chip first, unknown chips before all."""
    return devices.orderBy("rank", "device_model")


def criteria(counts: DataFrame, rows: list[tuple[str, str, str, float]]) -> DataFrame:
    """counts: one row; rows: (criterion, column of k, column of n, threshold). A row for each criterion with its interval and verdict."""
    listed = F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(k).alias("k"), F.col(n).alias("n"), F.lit(float(t)).alias("threshold")) for c, k, n, t in rows))
    out = counts.select(F.inline(listed))
    return out.withColumns(stats.proportion(F.col("k"), F.col("n"), F.col("threshold")))


def paired_wins(tasks: DataFrame, spine: list[str], task: str, arm: str, measures: list[str], better: str = "proto", base: str = "apple") -> DataFrame:
    """Medians of both arms for every task of the spine; wins where the better arm is strictly lower in all; an empty arm is NO DATA."""
    long = tasks.filter(F.col(arm).isin(better, base)).select(F.col(task).alias("task"), F.inline(F.array(*(F.struct(F.concat(F.col(arm), F.lit(f"_{m}")).alias("__name"), F.col(m).cast("double").alias("__measure")) for m in measures))))
    names = [f"{a}_{m}" for a in (better, base) for m in measures]
    medians = ranking.medians(long, ["task", "__name"], "__measure").groupBy("task").pivot("__name", names).agg(F.first("median"))
    out = tasks.sparkSession.createDataFrame([(s,) for s in spine], "task string").join(medians, "task", "left")
    known = F.lit(True)
    wins = F.lit(True)
    for m in measures:
        known &= F.col(f"{better}_{m}").isNotNull() & F.col(f"{base}_{m}").isNotNull()
        wins &= F.col(f"{better}_{m}") < F.col(f"{base}_{m}")
    return out.withColumn("verdict", F.when(~known, "NO DATA").when(wins, "PASS").otherwise("FAIL"))


def overall(n: Column, primary: Column, secondary: Column, least: int = 15) -> Column:
    """Too few: INCOMPLETE; both: PASS; the primary alone: GO WITH CONSTRAINTS."""
    return F.when(n < least, "INCOMPLETE").when((primary == "PASS") & (secondary == "PASS"), "PASS").when(primary == "PASS", "GO WITH CONSTRAINTS").otherwise("FAIL")


def study_b(participants: DataFrame, tasks: DataFrame, spine: list[str]) -> dict[str, DataFrame]:
    """Retrieval study from all-text tables: pilots apart; criteria, paired wins, kappa and the verdict row."""
    usable = participants.filter(coerce.yes("fair_config_ok"))
    pick = F.lower(F.trim(F.col("forced_choice"))).isin("prototype", "b", "proto")
    structural = F.upper(F.trim(F.col("reason_code_c1"))) == "STRUCTURAL"
    counts = usable.agg(F.count("*").alias("n"), F.count_if(pick).alias("k1"), F.count_if(pick & structural).alias("k2"), F.count_if(coerce.yes("passport_pred_proto_level1")).alias("k5a"), F.count_if(coerce.yes("passport_pred_proto_full")).alias("k5b"), F.count_if(coerce.yes("org_vocab_proto")).alias("k6"))
    table = criteria(counts, [("P-1", "k1", "n", 0.7), ("P-2", "k2", "k1", 0.7), ("P-5a", "k5a", "n", 0.6), ("P-5b", "k5b", "n", 0.4), ("P-6", "k6", "n", 0.5)])
    kept = tasks.join(usable.select("pid"), "pid", "left_semi").select("pid", "task", coerce.arm("arm").alias("arm"), coerce.number("time_s").alias("time_s"), coerce.number("steps").alias("steps"))
    wins = paired_wins(kept, spine, "task", "arm", ["time_s", "steps"])
    agreement = stats.kappa(usable, "reason_code_c1", "reason_code_c2").withColumn("band", stats.kappa_band(F.col("kappa")))
    return {"criteria": table, "wins": wins, "kappa": agreement, "pilots": participants.filter(~coerce.yes("fair_config_ok")), "verdict": _verdict_b(table, wins, agreement, counts)}


TASKS_WON = 4  # Fixed value: tasks of six to be won on both medians.


def _verdict_b(table: DataFrame, wins: DataFrame, agreement: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: P-1, P-2 (NO DATA where coders agree poorly), P-3, P-5 (both halves) and the study's verdict."""
    of = lambda name: F.max(F.when(F.col("criterion") == name, F.col("verdict")))
    flat = table.agg(of("P-1").alias("p1"), of("P-2").alias("p2"), F.when((of("P-5a") == "PASS") & (of("P-5b") == "PASS"), "PASS").otherwise("FAIL").alias("p5"))
    won = wins.agg(F.count_if(F.col("verdict") == "PASS").alias("won"), F.count_if(F.col("verdict") != "NO DATA").alias("known"))
    one = flat.crossJoin(won).crossJoin(agreement.agg(F.max("band").alias("band"))).crossJoin(counts.select("n"))  # one row each
    p3 = F.when(F.col("known") == 0, "NO DATA").when(F.col("won") >= TASKS_WON, "PASS").otherwise("FAIL")
    out = one.select("n", "p1", F.when(F.col("band") == "poor", "NO DATA").otherwise(F.col("p2")).alias("p2"), p3.alias("p3"), "p5")
    return out.withColumn("verdict", overall(F.col("n"), F.col("p1"), F.col("p3")))


HIGH_RISK, LOW_RISK = ["tol_id", "tol_contract"], ["tol_code", "tol_meme"]
TOLERANCES = ["tol_code", "tol_meme", "tol_burst", "tol_meal", "tol_receipt", "tol_workdoc", "tol_family", "tol_id", "tol_contract"]
VARIANTS = ["V1", "V2", "V3", "V4"]


def study_d(rows: DataFrame) -> dict[str, DataFrame]:
    """Delegation study from an all-text table: criteria, answers by content, gradient, crossover, variants and the verdict row."""
    if "forced_choice" in rows.columns:
        raise ValueError("this is the other study's table")
    said = lambda c, v: F.coalesce(F.lower(F.trim(F.col(c))) == v, F.lit(False))
    every = lambda columns, v: F.forall(F.array(*(said(c, v) for c in columns)), lambda x: x)
    mode = F.trim(F.col("mode_choice"))
    seconds = coerce.number("ledger_comprehension_s", 999.0)
    quick = (seconds > 0) & (seconds <= 20)
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(mode.isin("2", "3")).alias("k1"), F.count_if(mode == "3").alias("k2"), F.count_if(quick).alias("k3"), F.count_if(coerce.yes("identified_work_done")).alias("k4"),
        F.count_if(every(HIGH_RISK, "never")).alias("k5a"), F.count_if(every(LOW_RISK, "auto")).alias("k5b"), F.count_if(coerce.yes("recoverability_changed")).alias("k6"),
    )
    table = criteria(counts, [("D-P1", "k1", "n", 0.7), ("D-P2", "k2", "n", 0.4), ("D-P3", "k3", "n", 0.7), ("D-P4", "k4", "n", 0.6), ("D-P5a", "k5a", "n", 0.8), ("D-P5b", "k5b", "n", 0.6), ("D-P6", "k6", "n", 0.5)])
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("content"), F.lower(F.trim(F.col(c))).alias("answer")) for c in TOLERANCES))))
    matrix = on_spine(rows.sparkSession, "content", TOLERANCES, answers(long, F.col("content"), "content", F.col("answer"), ["auto", "ask", "never"]), {"auto": 0, "ask": 0, "never": 0})
    burden = review_burden(rows.select(coerce.number("queue_crossover").alias("crossover")), [], "crossover")
    by_variant = rows.groupBy(F.upper(F.trim(F.col("ledger_variant"))).alias("variant")).agg(F.count("*").alias("n"), F.count_if(quick).alias("understood"), F.count_if(coerce.yes("identified_work_done")).alias("said_done"), F.count_if(mode == "3").alias("autonomous"))
    variants = on_spine(rows.sparkSession, "variant", VARIANTS, by_variant, {"n": 0, "understood": 0, "said_done": 0, "autonomous": 0})
    of = lambda name: F.max(F.when(F.col("criterion") == name, F.col("verdict")))
    p5 = F.when((of("D-P5a") == "PASS") & (of("D-P5b") == "PASS"), "PASS").otherwise("FAIL")
    row = table.agg(F.max("n").alias("n"), of("D-P1").alias("p1"), p5.alias("p5"))
    verdict = row.withColumn("verdict", overall(F.col("n"), F.col("p1"), F.col("p5"))).withColumn("escalate", F.col("p1") == "FAIL")
    return {"criteria": table, "answers": matrix, "gradient": gradient(rows, TOLERANCES), "burden": burden, "variants": variants, "verdict": verdict}


def answers(rows: DataFrame, by: Column, name: str, answer: Column, domain: list[str]) -> DataFrame:
    """A row for each value of by, a column for each answer of the fixed domain: how often it was given; others are not counted."""
    return rows.groupBy(by.alias(name)).agg(*(F.count_if(answer == a).alias(a) for a in domain))


def review_burden(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, crossover (the exact median of the values above 0) and per_1000; groups without any are left out, but for the one row without by."""
    got = ranking.medians(rows.filter(F.col(column) > 0), by, column)
    return got.select(*by, F.col("median").alias("crossover"), (F.col("median") / 10).alias("per_1000"))


def gradient(df: DataFrame, columns: list[str], value: str = "auto", margin: float = 0.3) -> DataFrame:
    """Mean rate of `value` in the first two columns against the last two: GRADED where it is more than margin higher."""
    rate = lambda c: F.avg((F.lower(F.trim(F.col(c))) == value).cast("double"))
    out = df.agg(((rate(columns[0]) + rate(columns[1])) / 2).alias("low_risk"), ((rate(columns[-2]) + rate(columns[-1])) / 2).alias("high_risk"))
    return out.withColumn("gradient", F.when(F.col("low_risk").isNull(), "NO DATA").when(F.col("low_risk") > F.col("high_risk") + margin, "GRADED").otherwise("FLAT"))


def on_spine(spark: SparkSession, column: str, domain: list[str], measured: DataFrame, fill: dict) -> DataFrame:
    """measured with a row for every value of the fixed domain, and none beside it."""
    return spark.createDataFrame([(d,) for d in domain], f"{column} string").join(measured, column, "left").na.fill(fill)
