"""The two studies, over customers as participants and orders as tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import verdicts
from ledgerline.plans.base import WILSON, query, r

TASKS = ["T1", "T2", "T3", "T4", "T5", "T6"]


def _people(t):
    k, nation = F.col("c_custkey"), F.col("c_nationkey") % 4
    return t("customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("pid"), F.when(k % 11 == 0, "no").otherwise(" Yes ").alias("fair_config_ok"),
        F.when(nation == 0, "Prototype").when(nation == 1, " b").when(nation == 2, "apple").otherwise("proto").alias("forced_choice"),
        F.when(F.col("c_acctbal") > 4000, " STRUCTURAL").otherwise("HABIT").alias("reason_code_c1"), F.when(F.col("c_acctbal") > 3500, "STRUCTURAL ").when(k % 9 == 0, " ").otherwise("HABIT").alias("reason_code_c2"),
        F.when(k % 5 != 0, "y").otherwise("n").alias("passport_pred_proto_level1"), F.when(k % 2 == 0, "1").alias("passport_pred_proto_full"), F.when(k % 3 == 0, "TRUE").otherwise("no").alias("org_vocab_proto"),
    )


def _tasks(t):
    status = F.col("o_orderstatus")
    return t("orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("pid"), F.concat(F.lit("T"), (F.col("o_orderkey") % 7 + 1).cast("string")).alias("task"),
        F.when(status == "F", "b").when(status == "P", "Proto").alias("arm"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("time_s"), (F.col("o_orderkey") % 40).cast("string").alias("steps"),
    )


def _study_b(t):
    return verdicts.study_b(_people(t), _tasks(t), TASKS)


_B = f"""u AS (SELECT c_custkey k, c_nationkey % 4 <> 2 pick, c_acctbal > 4000 s1, CASE WHEN c_acctbal > 3500 THEN 'S' WHEN c_custkey % 9 = 0 THEN '' ELSE 'H' END s2 FROM customer WHERE c_custkey % 11 <> 0),
c AS (SELECT count(*) n, count(*) FILTER (pick) k1, count(*) FILTER (pick AND s1) k2, count(*) FILTER (k % 5 <> 0) k5a, count(*) FILTER (k % 2 = 0) k5b, count(*) FILTER (k % 3 = 0) k6 FROM u),
l AS (SELECT 'P-1' criterion, k1 k, n, 0.7::DOUBLE threshold FROM c UNION ALL SELECT 'P-2', k2, k1, 0.7 FROM c UNION ALL SELECT 'P-5a', k5a, n, 0.6 FROM c UNION ALL SELECT 'P-5b', k5b, n, 0.4 FROM c UNION ALL SELECT 'P-6', k6, n, 0.5 FROM c),
w AS (SELECT *, greatest(0.0, {WILSON.format(s="-")}) lo, least(1.0, {WILSON.format(s="+")}) hi, k / n::DOUBLE p FROM l),
tk AS (SELECT 'T' || (o_orderkey % 7 + 1) task, o_orderstatus IN ('F', 'P') proto, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END s, (o_orderkey % 40)::DOUBLE st FROM orders JOIN u ON o_custkey = k),
m AS (SELECT task, median(s) FILTER (proto) ps, median(s) FILTER (NOT proto) bs, median(st) FILTER (proto) pt, median(st) FILTER (NOT proto) bt FROM tk GROUP BY 1),
wins AS (SELECT task, ps, pt, bs, bt, CASE WHEN ps IS NULL OR bs IS NULL THEN 'NO DATA' WHEN ps < bs AND pt < bt THEN 'PASS' ELSE 'FAIL' END verdict FROM (VALUES ('T1'), ('T2'), ('T3'), ('T4'), ('T5'), ('T6')) s(task) LEFT JOIN m USING (task)),
kp AS (SELECT count(*) n, avg((s1 = (s2 = 'S'))::INT) o, (sum(s1::INT)::DOUBLE * sum((s2 = 'S')::INT) + sum((NOT s1)::INT)::DOUBLE * sum((s2 <> 'S')::INT)) / (count(*)::DOUBLE * count(*)) e FROM u WHERE s2 <> ''),
kk AS (SELECT *, CASE WHEN e >= 1 THEN 1.0 ELSE (o - e) / (1 - e) END kappa FROM kp)"""


@query(f"""WITH {_B} SELECT criterion, k, n, round(p, 6) p, round(lo, 6) low, round(hi, 6) high, CASE WHEN p >= threshold THEN 'PASS' ELSE 'FAIL' END verdict, lo < threshold AND threshold < hi AS inconclusive FROM w""")
def study_b_criteria(spark, t):
    return _study_b(t)["criteria"].select("criterion", "k", "n", r("p").alias("p"), r("low").alias("low"), r("high").alias("high"), "verdict", "inconclusive")


@query(f"""WITH {_B} SELECT task, round(ps, 4) proto_time_s, pt proto_steps, round(bs, 4) apple_time_s, bt apple_steps, verdict FROM wins""")
def study_b_wins(spark, t):
    got = _study_b(t)["wins"]
    return got.select("task", r("proto_time_s", 4).alias("proto_time_s"), "proto_steps", r("apple_time_s", 4).alias("apple_time_s"), "apple_steps", "verdict")


@query(f"""WITH {_B} SELECT n, round(o, 6) observed, round(e, 6) expected, round(kappa, 6) kappa, CASE WHEN kappa < 0.4 THEN 'poor' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'strong' END band FROM kk""")
def study_b_kappa(spark, t):
    return _study_b(t)["kappa"].select("n", r("observed").alias("observed"), r("expected").alias("expected"), r("kappa").alias("kappa"), "band")


@query("""SELECT 'p' || c_custkey AS pid, c_custkey % 5 <> 0 AS level1 FROM customer WHERE c_custkey % 11 = 0""")
def study_b_pilots(spark, t):
    return _study_b(t)["pilots"].select("pid", (F.col("passport_pred_proto_level1") == "y").alias("level1"))


@query(f"""WITH {_B}, v AS (SELECT max(n) FILTER (criterion = 'P-1') n, max(p >= threshold) FILTER (criterion = 'P-1') a1, max(p >= threshold) FILTER (criterion = 'P-2') a2, min((p >= threshold)::INT) FILTER (criterion IN ('P-5a', 'P-5b')) = 1 a5 FROM w),
x AS (SELECT *, (SELECT count(*) FROM wins WHERE verdict = 'PASS') won, (SELECT count(*) FROM wins WHERE verdict <> 'NO DATA') known, (SELECT kappa FROM kk) kappa FROM v),
y AS (SELECT n, CASE WHEN a1 THEN 'PASS' ELSE 'FAIL' END p1, CASE WHEN kappa < 0.4 THEN 'NO DATA' WHEN a2 THEN 'PASS' ELSE 'FAIL' END p2, CASE WHEN known = 0 THEN 'NO DATA' WHEN won >= 4 THEN 'PASS' ELSE 'FAIL' END p3, CASE WHEN a5 THEN 'PASS' ELSE 'FAIL' END p5 FROM x)
SELECT *, CASE WHEN n < 15 THEN 'INCOMPLETE' WHEN p1 = 'PASS' AND p3 = 'PASS' THEN 'PASS' WHEN p1 = 'PASS' THEN 'GO WITH CONSTRAINTS' ELSE 'FAIL' END verdict FROM y""")
def study_b_verdict(spark, t):
    return _study_b(t)["verdict"]


def _delegation(t):
    k = F.col("c_custkey")
    tol = {c: F.when((k + i) % 4 < 2, "auto").when((k + i) % 4 == 2, "ask").otherwise("Never ") for i, c in enumerate(verdicts.TOLERANCES)}
    tol |= {c: F.when(k % 7 == 0, "ask").otherwise("AUTO") for c in verdicts.LOW_RISK} | {c: F.when(k % 6 == 0, "ask").otherwise(" never") for c in verdicts.HIGH_RISK}
    return t("customer").select(
        F.concat(F.lit("p"), k.cast("string")).alias("pid"), F.concat(F.when(k % 2 == 0, "v").otherwise("V"), (k % 3 + 1).cast("string"), F.lit(" ")).alias("ledger_variant"), (k % 4).cast("string").alias("mode_choice"),
        F.when(k % 30 == 0, "").otherwise((k % 30).cast("string")).alias("ledger_comprehension_s"), F.when(F.col("c_nationkey") % 3 != 0, "yes").otherwise("n").alias("identified_work_done"),
        *(v.alias(c) for c, v in tol.items()), F.when(k % 4 != 0, "y").alias("recoverability_changed"), (k % 50).cast("string").alias("queue_crossover"),
    )


def _study_d(t):
    return verdicts.study_d(_delegation(t))


_D = f"""u AS (SELECT c_custkey k, (c_custkey % 30) BETWEEN 1 AND 20 quick, c_nationkey % 3 <> 0 done FROM customer),
c AS (SELECT count(*) n, count(*) FILTER (k % 4 IN (2, 3)) k1, count(*) FILTER (k % 4 = 3) k2, count(*) FILTER (quick) k3, count(*) FILTER (done) k4, count(*) FILTER (k % 6 <> 0) k5a, count(*) FILTER (k % 7 <> 0) k5b, count(*) FILTER (k % 4 <> 0) k6 FROM u),
l AS (SELECT unnest([{{'c': 'D-P1', 'k': k1, 't': 0.7::DOUBLE}}, {{'c': 'D-P2', 'k': k2, 't': 0.4}}, {{'c': 'D-P3', 'k': k3, 't': 0.7}}, {{'c': 'D-P4', 'k': k4, 't': 0.6}}, {{'c': 'D-P5a', 'k': k5a, 't': 0.8}}, {{'c': 'D-P5b', 'k': k5b, 't': 0.6}}, {{'c': 'D-P6', 'k': k6, 't': 0.5}}]) x, n FROM c),
q AS (SELECT x.c criterion, x.k k, n, x.t threshold FROM l), w AS (SELECT *, greatest(0.0, {WILSON.format(s="-")}) lo, least(1.0, {WILSON.format(s="+")}) hi, k / n::DOUBLE p FROM q)"""


@query(f"""WITH {_D} SELECT criterion, k, n, round(p, 6) p, round(lo, 6) low, round(hi, 6) high, CASE WHEN p >= threshold THEN 'PASS' ELSE 'FAIL' END verdict, lo < threshold AND threshold < hi AS inconclusive FROM w""")
def study_d_criteria(spark, t):
    return _study_d(t)["criteria"].select("criterion", "k", "n", r("p").alias("p"), r("low").alias("low"), r("high").alias("high"), "verdict", "inconclusive")


@query("""WITH a AS (SELECT unnest([{'c': 'tol_code', 'v': CASE WHEN c_custkey % 7 = 0 THEN 'ask' ELSE 'auto' END}, {'c': 'tol_meme', 'v': CASE WHEN c_custkey % 7 = 0 THEN 'ask' ELSE 'auto' END},
 """ + ", ".join(f"{{'c': '{c}', 'v': CASE WHEN (c_custkey + {i}) % 4 < 2 THEN 'auto' WHEN (c_custkey + {i}) % 4 = 2 THEN 'ask' ELSE 'never' END}}" for i, c in enumerate(verdicts.TOLERANCES) if 2 <= i <= 6) + """,
 {'c': 'tol_id', 'v': CASE WHEN c_custkey % 6 = 0 THEN 'ask' ELSE 'never' END}, {'c': 'tol_contract', 'v': CASE WHEN c_custkey % 6 = 0 THEN 'ask' ELSE 'never' END}]) x FROM customer)
SELECT x.c AS content, count(*) FILTER (x.v = 'auto') auto, count(*) FILTER (x.v = 'ask') ask, count(*) FILTER (x.v = 'never') never FROM a GROUP BY 1""")
def study_d_answers(spark, t):
    return _study_d(t)["answers"]


@query("""WITH g AS (SELECT avg((c_custkey % 7 <> 0)::INT) low_risk FROM customer) SELECT round(low_risk, 6) low_risk, 0.0::DOUBLE AS high_risk, CASE WHEN low_risk > 0.3 THEN 'GRADED' ELSE 'FLAT' END gradient FROM g""")
def study_d_gradient(spark, t):
    return _study_d(t)["gradient"].select(r("low_risk").alias("low_risk"), "high_risk", "gradient")


@query("""SELECT median(c_custkey % 50) AS crossover, median(c_custkey % 50) / 10 AS per_1000 FROM customer WHERE c_custkey % 50 > 0""")
def study_d_burden(spark, t):
    return _study_d(t)["burden"]


@query("""SELECT v AS variant, coalesce(n, 0) n, coalesce(understood, 0) understood, coalesce(said_done, 0) said_done, coalesce(autonomous, 0) autonomous FROM (VALUES ('V1'), ('V2'), ('V3'), ('V4')) s(v)
LEFT JOIN (SELECT 'V' || (c_custkey % 3 + 1) v, count(*) n, count(*) FILTER ((c_custkey % 30) BETWEEN 1 AND 20) understood, count(*) FILTER (c_nationkey % 3 <> 0) said_done, count(*) FILTER (c_custkey % 4 = 3) autonomous FROM customer GROUP BY 1) USING (v)""")
def study_d_variants(spark, t):
    return _study_d(t)["variants"]


@query(f"""WITH {_D}, v AS (SELECT max(n) n, CASE WHEN max(p >= threshold) FILTER (criterion = 'D-P1') THEN 'PASS' ELSE 'FAIL' END p1, CASE WHEN min((p >= threshold)::INT) FILTER (criterion IN ('D-P5a', 'D-P5b')) = 1 THEN 'PASS' ELSE 'FAIL' END p5 FROM w)
SELECT *, CASE WHEN n < 15 THEN 'INCOMPLETE' WHEN p1 = 'PASS' AND p5 = 'PASS' THEN 'PASS' WHEN p1 = 'PASS' THEN 'GO WITH CONSTRAINTS' ELSE 'FAIL' END verdict, p1 = 'FAIL' AS escalate FROM v""")
def study_d_verdict(spark, t):
    return _study_d(t)["verdict"]
