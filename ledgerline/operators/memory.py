"""Assets as memories: the staged index, duplicates, moments, places, trips, retrieval, and how well classes and entities are told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import signals


def index_assets(assets: DataFrame, costly: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The staged pipeline of one run: assets (missing, screenshot, width, height, score) are gated by cheap signals, `costly` adds its columns to those let through,
    and all come back together. A missing image is kept and counted as failed; it and what is gated out have NULL in the costly columns."""
    gate = signals.gate(F.col("screenshot"), F.col("width"), F.col("height"), F.col("score"))
    gated = assets.withColumn("__gate", gate)
    gated = gated.withColumns({"failed": F.coalesce("missing", F.lit(False)), "reason": F.when(F.coalesce("missing", F.lit(False)), "missing").otherwise(F.col("__gate.reason"))})
    gated = gated.withColumn("attempted", ~F.col("failed") & F.col("__gate.run")).drop("__gate")
    return costly(gated.filter("attempted")).unionByName(gated.filter("NOT attempted"), allowMissingColumns=True)


def stage_counters(indexed: DataFrame, cost: str) -> DataFrame:
    """One row: indexed, attempted, gated_out, failed and the mean cost of an attempt, 0 without attempts."""
    return indexed.agg(
        F.count("*").alias("indexed"), F.count_if("attempted").alias("attempted"), F.count_if(F.col("reason") == "gated-out").alias("gated_out"), F.count_if("failed").alias("failed"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("attempted"), F.col(cost))), F.count_if("attempted")), F.lit(0.0)).alias("cost_per_attempt"),
    )


def cancellable(spark, group: str, work: Callable[[], object]) -> object:
    """Runs work in a job group that spark.sparkContext.cancelJobGroup(group) stops between tasks."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def exact_duplicates(assets: DataFrame, id_column: str, by: list[str]) -> DataFrame:
    """id, original (the smallest id) and copies, for all rows of groups of more than one. One aggregation and one join."""
    groups = assets.groupBy(*by).agg(F.min(id_column).alias("original"), F.count("*").alias("copies")).filter("copies > 1")
    return assets.join(groups, by).select(id_column, "original", "copies")


def skip_duplicates(assets: DataFrame, id_column: str, hash_column: str, confirm: str) -> DataFrame:
    """assets with linked_to and dedup_skipped: rows of one hash that a second signal confirms are linked to the first of them and need no costly stage.
    NULL (not hashed) and 0 (a whole class of flat images) link nothing, nor does an unknown second signal."""
    usable = F.col(hash_column).isNotNull() & (F.col(hash_column) != 0) & F.col(confirm).isNotNull()
    first = assets.filter(usable).groupBy(F.col(hash_column).alias("__h"), F.col(confirm).alias("__c")).agg(F.min(id_column).alias("__first"))
    joined = assets.join(first, usable & (F.col(hash_column) == F.col("__h")) & (F.col(confirm) == F.col("__c")), "left")
    linked = F.when(F.col("__first") != F.col(id_column), F.col("__first"))
    return joined.withColumns({"linked_to": linked, "dedup_skipped": linked.isNotNull()}).drop("__h", "__c", "__first")


def near_hashes(classes: DataFrame, hash_column: str, radius: int) -> DataFrame:
    """a, b, distance: pairs of different 64-bit hashes in at most radius bits. classes: each hash once; the hash 0 is no evidence and left out.

    Hashes are cut into radius + 1 bands; two within the radius agree in a band, and the first such band gives the pair, so copies are never expanded into pairs.
    """
    n, low, masks = radius + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        m = ((1 << width) - 1) << low
        masks.append(m - (1 << 64) if m >> 63 else m)
        low += width
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    h = F.col(hash_column)
    keyed = classes.filter(h.isNotNull() & (h != 0)).select(h.alias("a"), F.posexplode(F.transform(table, lambda m: m.bitwiseAND(h))).alias("band", "value"))
    other = keyed.toDF("b", "band", "value")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.forall(F.slice(table, F.lit(1), F.col("band")), lambda m: m.bitwiseAND(differ) != 0)
    met = keyed.join(other, ["band", "value"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & first)
    return met.select("a", "b", F.bit_count(differ).alias("distance"))


def sessions(rows: DataFrame, by: list[str], at: str, gap_s: float, order: list[str], same: list[str] | None = None, name: str = "session") -> DataFrame:
    """rows with a number for each run of rows no more than gap_s apart; with `same`, a change of any of those columns also starts one."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    before = F.lag(seconds).over(w)
    new = before.isNull() | ((seconds - before) / 1e6 > gap_s)
    for c in same or []:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w)).drop("__new")


def moments(rows: DataFrame, by: list[str], at: str, gap_s: float, id_column: str, score: str, kind: str) -> DataFrame:
    """rows with moment, representative (best score, then the smallest id) and equivalent: only what is of the representative's kind may stand back for it."""
    grouped = sessions(rows, by, at, gap_s, [id_column], name="moment")
    best = grouped.groupBy(*by, "moment").agg(F.min_by(F.struct(F.col(id_column).alias("id"), F.col(kind).alias("kind")), F.struct(-F.col(score), F.col(id_column))).alias("__best"))
    joined = grouped.join(best, [*by, "moment"])
    return joined.withColumns({"representative": F.col("__best.id"), "equivalent": F.col(kind).eqNullSafe(F.col("__best.kind"))}).drop("__best")


def value_loss(grouped: DataFrame, id_column: str) -> DataFrame:
    """One row: rows, moments' representatives kept, rows that stand back, and the share that would be lost if others stood back as well."""
    stands_back = F.col("equivalent") & (F.col(id_column) != F.col("representative"))
    lost = ~F.col("equivalent")
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col(id_column) == F.col("representative")).alias("kept"), F.count_if(stands_back).alias("stand_back"), F.coalesce(F.try_divide(F.count_if(lost).cast("double"), F.count("*")), F.lit(0.0)).alias("value_loss_rate"))


def inferred_places(rows: DataFrame, by: list[str], at: str, place: str, order: str, within_s: float) -> DataFrame:
    """rows with place, place_source and place_confidence: a known place has confidence 1; an unknown one takes that of the nearer neighbour in time (ties: the earlier),
    its confidence falling to 0 at within_s; beyond that it stays unknown."""
    back = Window.partitionBy(*by).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    known = F.when(F.col(place).isNotNull(), F.struct(F.col(place).alias("p"), seconds.alias("s")))
    seen = rows.withColumn("__s", seconds).withColumns({"__b": F.last(known, ignorenulls=True).over(back), "__a": F.last(known, ignorenulls=True).over(ahead)})
    to_b, to_a = F.col("__s") - F.col("__b.s"), F.col("__a.s") - F.col("__s")
    nearer_b = to_b.isNotNull() & (to_a.isNull() | (to_b <= to_a))
    far = F.when(nearer_b, to_b).otherwise(to_a)
    guess = F.when(nearer_b, F.col("__b.p")).otherwise(F.col("__a.p"))
    usable = far.isNotNull() & (far < within_s)
    source = F.when(F.col(place).isNotNull(), "gps").when(usable, "neighbour").otherwise("unknown")
    confidence = F.when(F.col(place).isNotNull(), 1.0).when(usable, 1 - far / within_s).otherwise(0.0)
    return seen.withColumns({"place_source": source, "place_confidence": confidence, "__place": F.coalesce(place, F.when(usable, guess))}).drop(place, "__s", "__a", "__b").withColumnRenamed("__place", place)


def trips(rows: DataFrame, by: list[str], at: str, place: str, order: str, gap_s: float, home: str | None = None, least: int = 2) -> DataFrame:
    """by, trip, place, start, end, n: runs of rows in one place that no gap breaks, away from home, of at least so many rows."""
    runs = sessions(rows, by, at, gap_s, [order], same=[place], name="trip").filter(F.col(place).isNotNull())
    away = runs if home is None else runs.filter(~F.col(place).eqNullSafe(F.col(home)))
    return away.groupBy(*by, "trip", place).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least)


def in_windows(rows: DataFrame, windows: DataFrame, place: str, at: str) -> DataFrame:
    """rows with the named windows (place, a, b: from a up to b) that they fall into. windows: hand-written and small, so the optimizer broadcasts it."""
    return rows.join(windows, place).filter((F.col(at) >= F.col("a")) & (F.col(at) < F.col("b")))


def browse(entries: DataFrame, node: str, separator: str = " > ") -> DataFrame:
    """Entries (id, path) at or below a node."""
    return entries.filter((F.col("path") == node) | F.col("path").startswith(node + separator))


def timeline(assets: DataFrame, at: str, year: int, month: int | None = None) -> DataFrame:
    """Assets of a year or a month, as a range that a scan can skip by."""
    start = f"{year}-{month or 1:02d}-01"
    end = f"{year + 1}-01-01" if month in (None, 12) else f"{year}-{month + 1:02d}-01"
    return assets.filter((F.col(at) >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00"))) & (F.col(at) < F.to_timestamp_ntz(F.lit(f"{end} 00:00:00"))))


def intent(assets: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Assets whose text holds all words, whatever their case."""
    said = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return assets.filter(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(said, F.lower(w))))


def relations(entries: DataFrame, id_column: str, path: str) -> DataFrame:
    """path, n: how many assets of the given path are also under each other path."""
    mine = entries.filter(F.col("path") == path).select(id_column).distinct()
    return entries.join(mine, id_column, "left_semi").filter(F.col("path") != path).groupBy("path").agg(F.count_distinct(id_column).alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n; an unknown prediction is a class of its own."""
    return rows.groupBy(F.col(truth).alias("truth"), F.coalesce(F.col(predicted), F.lit("unknown")).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall: from the confusion counts, so its size is that of the classes."""
    cells = confusion(rows, truth, predicted)
    sides = cells.select(F.inline(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    got = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("given"), (F.sum("hit") / 2).alias("hit"))
    return got.select("class", "support", F.coalesce(F.try_divide("hit", "given"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)).alias("recall"))


def coverage(rows: DataFrame, predicted: str, confidence: str, least: float) -> DataFrame:
    """One row: n, coverage (classified with enough confidence) and unknown_ratio."""
    sure = F.col(predicted).isNotNull() & (F.col(confidence) >= least)
    share = F.coalesce(F.try_divide(F.count_if(sure).cast("double"), F.count("*")), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), share.alias("coverage"), (1 - share).alias("unknown_ratio"))


def entity_report(rows: DataFrame, truth: str, resolved: str) -> DataFrame:
    """One row: pairs that are one entity in truth, as resolved and both, precision, recall, f1, false merges and false splits. Pairs are counted from group sizes, never made."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(resolved).alias("r")).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(pairs(F.col("n")).alias("both"))
    true = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("true"))
    made = cells.groupBy("r").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("made"))
    one = both.crossJoin(true).crossJoin(made)  # one row each
    p, r = F.coalesce(F.try_divide("both", "made"), F.lit(0.0)), F.coalesce(F.try_divide("both", "true"), F.lit(0.0))
    return one.select("true", "made", "both", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), (F.col("made") - F.col("both")).alias("false_merges"), (F.col("true") - F.col("both")).alias("false_splits"))


def ablation(rows: DataFrame, truth: str, signals_: list[str]) -> DataFrame:
    """signals, n, accuracy: each signal alone and the vote of all of them (the first to speak decides ties), in one pass. signals_: columns that hold a class or NULL."""
    sets = [(s, F.col(s)) for s in signals_]
    votes = F.filter(F.array(*map(F.col, signals_)), lambda v: v.isNotNull())
    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
    most = F.array_max(F.transform(votes, count))
    sets.append(("+".join(signals_), F.get(F.filter(votes, lambda v: count(v) == most), F.lit(0))))
    hits = rows.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(c == F.col(truth), F.lit(False))).alias(f"h{i}") for i, (_, c) in enumerate(sets)))
    return hits.select(F.inline(F.array(*(F.struct(F.lit(name).alias("signals"), F.col("n"), F.coalesce(F.try_divide(F.col(f"h{i}").cast("double"), F.col("n")), F.lit(0.0)).alias("accuracy")) for i, (name, _) in enumerate(sets)))))


def samples_summary(samples: DataFrame, by: list[str], peak: str, mean: str) -> DataFrame:
    """by, peak, mean: the largest of one measure and the mean of another, 0 where nothing was measured."""
    return samples.groupBy(*by).agg(F.max(peak).alias("peak"), F.coalesce(F.avg(mean), F.lit(0.0)).alias("mean"))


def wrapping_step(seed: Column) -> Column:
    """seed * 6364136223846793005 + 1442695040888963407 modulo 2**64, for an unsigned seed as decimal(20, 0), without overflow anywhere."""
    # Multiplier and increment of the reference's generator, the multiplier in two halves of 32 bits.
    high, low = divmod(6364136223846793005, 1 << 32)
    whole, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")
    wide = lambda c: c.cast("decimal(20,0)")
    a = (wide(seed) * F.lit(low).cast("decimal(10,0)")).cast("decimal(38,0)") % whole
    b = (wide(seed % half) * F.lit(high).cast("decimal(10,0)")).cast("decimal(38,0)") % half * F.lit(1 << 32).cast("decimal(12,0)")
    return ((a + b.cast("decimal(38,0)") + F.lit(1442695040888963407).cast("decimal(38,0)")) % whole).cast("decimal(20,0)")
