"""Decision tables: gates, the risk ladder, actions, lifecycle, key figures, learned preferences, unit economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Funnel thresholds in percent, and the visitors an arm needs before its rates are read.
CLICK_RATE, LEAD, SURVIVES, PRICE, VISITORS = 2.5, 1.0, 50.0, 15.0, 400
# Risk levels from disposable to irreplaceable, and the default action of each.
RISKS = {"R0": "Auto-Clean", "R1": "Auto-Clean", "R2": "Suggest", "R3": "Review", "R4": "Archive", "R5": "Protect", "R6": "Protect"}
# The states in which access to a library can be.
ACCESS = {0: "notDetermined", 1: "restricted", 2: "denied", 3: "authorized", 4: "limited"}


def passes(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def funnel_verdict(counts: DataFrame, arm: str, control: str, entered: str, asked: str, bought: str, paid: str, least: int = VISITORS) -> DataFrame:
    """One row: the four funnel criteria over the better of the arms that are not the control, and the verdict.

    p1: bought/entered of the better arm; p2: its lead over the control, more than nothing and at least LEAD points; p3: paid/bought; p4: bought/asked.
    PASS: p1 and p2; GO WITH CONSTRAINTS: p1 alone; a primary failure is a FAIL of the commercial model. With fewer visitors than `least` in any arm, INCOMPLETE.
    """
    percent = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    rated = counts.select(arm, F.col(entered).alias("visitors"), percent(bought, entered).alias("rate"), percent(paid, bought).alias("survives"), percent(bought, asked).alias("price"))
    test = F.col(arm).cast("string") != control
    best = F.max(F.when(test, F.struct("rate", "survives", "price", F.col(arm).cast("string").alias("arm")))).alias("best")
    one = rated.agg(best, F.max(F.when(~test, F.col("rate"))).alias("control"), F.min("visitors").alias("visitors"))
    flat = one.select(F.col("best.arm").alias("arm"), F.col("best.rate").alias("rate"), F.coalesce("control", F.lit(0.0)).alias("control"), F.coalesce("visitors", F.lit(0)).alias("visitors"), "best.survives", "best.price")
    lead = F.col("rate") - F.col("control")
    judged = flat.withColumns({"p1": passes(F.col("rate") >= CLICK_RATE), "p2": passes((lead > 0) & (lead >= LEAD)), "p3": passes(F.col("survives") >= SURVIVES), "p4": passes(F.col("price") >= PRICE)})
    verdict = F.when((F.col("visitors") < least) | F.col("arm").isNull(), "INCOMPLETE").when(F.col("p1") == "FAIL", "FAIL").when(F.col("p2") == "PASS", "PASS").otherwise("GO WITH CONSTRAINTS")
    return judged.withColumn("verdict", verdict)


def tier_gate(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """outcome of the device, retrieval and payment studies; the delegation study is reported beside it and never changes it. A study that is neither passed nor failed leaves the gate open."""
    failed = lambda x: x == "FAIL"
    outcome = F.when(failed(a) | failed(b), "NO-GO / PIVOT").when((a == "PASS") & (b == "PASS") & (c == "PASS"), "GO").when((a == "PASS") & (b == "PASS") & failed(c), "GO + COMMERCIAL PIVOT").otherwise("OPEN")
    beside = F.when(d == "PASS", "policy engine supported").when(d == "GO WITH CONSTRAINTS", "assistance by default").when(failed(d), "escalate").otherwise("open")
    return {"outcome": outcome, "delegation": beside}


def default_action(risk: Column) -> Column:
    """The ladder's action; an unknown level is reviewed."""
    table = F.create_map(*(F.lit(x) for pair in RISKS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, risk), F.lit("Review"))


def rules(spark: SparkSession, listed: list[tuple]) -> DataFrame:
    """A rule table: priority, risk (NULL: any), least_confidence, recoverable (NULL: either), action."""
    return spark.createDataFrame(listed, "priority int, risk string, least_confidence double, needs_recoverable boolean, rule_action string")


def act(assets: DataFrame, table: DataFrame, key: str, preference: str | None = None) -> DataFrame:
    """assets (key, risk, confidence, recoverable) with action: the first rule by priority that fits, the ladder's default where none does.
    A preference may make an action of the risks below R4 stricter or laxer; nothing from R4 up is ever cleaned without being asked."""
    listed = table.select(F.struct("priority", F.col("risk").alias("rule_risk"), "least_confidence", "needs_recoverable", "rule_action").alias("r")).agg(F.sort_array(F.collect_list("r")).alias("__rules"))  # a hand-written table
    hit = assets.crossJoin(F.broadcast(listed))  # one row
    test = lambda r: (r["rule_risk"].isNull() | (r["rule_risk"] == F.col("risk"))) & (F.col("confidence") >= r["least_confidence"]) & (r["needs_recoverable"].isNull() | (r["needs_recoverable"] == F.col("recoverable")))
    first = F.get(F.filter("__rules", test), F.lit(0))["rule_action"]
    action = F.coalesce(first, default_action(F.col("risk")))
    if preference:
        action = F.when(F.col("risk").isin("R0", "R1", "R2", "R3"), F.coalesce(F.col(preference), action)).otherwise(action)
    action = F.when(F.col("risk").isin("R4", "R5", "R6") & (action == "Auto-Clean"), "Protect").otherwise(action)
    return hit.withColumn("action", action).drop("__rules")


def lifecycle(category_risk: Column, age_days: Column, done: Column, short_lived: Column, expires: int = 30) -> Column:
    """Protect, Keep, Archive, Review or Suggest-Delete. High risks are never suggested for deletion; a short-lived asset whose task is not known to be done is reviewed."""
    return (
        F.when(category_risk.isin("R5", "R6"), "Protect")
        .when(category_risk == "R4", "Archive")
        .when(short_lived & (age_days > expires), F.when(F.coalesce(done, F.lit(False)), "Suggest-Delete").otherwise("Review"))
        .when(age_days > 365, "Archive")
        .otherwise("Keep")
    )


def key_figures(decisions: DataFrame) -> DataFrame:
    """decisions: action, correct, weight (importance), recoverable, category. One row: automation ratio, reviews in 1,000, weighted error cost, catastrophic error rate, coverage."""
    n = F.count("*")
    wrong = ~F.col("correct")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), n), F.lit(0.0))
    cost = F.sum(F.when(wrong, F.col("weight") * F.when(F.col("recoverable"), 1.0).otherwise(10.0)).otherwise(0.0))
    return decisions.agg(
        n.alias("n"), share(F.col("action") != "Review").alias("automation_ratio"), (share(F.col("action") == "Review") * 1000).alias("review_burden"), F.coalesce(F.try_divide(cost, n), F.lit(0.0)).alias("weighted_error_cost"),
        share(wrong & ~F.col("recoverable") & (F.col("weight") >= 5)).alias("catastrophic_error_rate"), share(F.col("category").isNotNull()).alias("coverage"),
    )


def learned_policy(feedback: DataFrame, by: list[str], action: str, at: str, resets: DataFrame | None = None, least: int = 5, share: float = 0.8) -> DataFrame:
    """by, action, samples, confidence: a rule wherever one action has at least `share` of at least `least` answers given after the last reset (by, at). Ties to the smaller action."""
    if resets is not None:
        last = resets.groupBy(*by).agg(F.max(at).alias("__reset"))
        feedback = feedback.join(last, by, "left").filter(F.col("__reset").isNull() | (F.col(at) > F.col("__reset"))).drop("__reset")
    counts = feedback.groupBy(*by, action).agg(F.count("*").alias("c"))
    best = counts.groupBy(*by).agg(F.sum("c").alias("samples"), F.max("c").alias("__most"), F.min_by(action, F.struct(-F.col("c"), F.col(action))).alias(action))
    return best.withColumn("confidence", F.col("__most") / F.col("samples")).filter((F.col("samples") >= least) & (F.col("confidence") >= share)).drop("__most")


def unit_economics(spark: SparkSession, users: list[int], fixed_cost: float, cost_each: float, price: float, paying: float, store_cut: float) -> DataFrame:
    """A row for each scale: income after the store's cut, cost, gross margin and the users that break even (NULL where no user ever pays for itself)."""
    each = price * paying * (1 - store_cut) - cost_each
    scale = spark.createDataFrame([(u,) for u in users], "users long")
    income, cost = F.col("users") * (price * paying * (1 - store_cut)), F.lit(fixed_cost) + F.col("users") * cost_each
    out = scale.withColumns({"income": income, "cost": cost})
    even = F.ceil(F.lit(fixed_cost / each)).cast("long") if each > 0 else F.lit(None).cast("long")
    return out.withColumns({"margin": F.try_divide(F.col("income") - F.col("cost"), F.col("income")), "break_even_users": even})


def access_state(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ACCESS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))
