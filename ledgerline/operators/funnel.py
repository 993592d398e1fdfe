"""Conversion funnels from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.coerce import ratio
from ledgerline.operators.incremental import batch_numbers


def unique_sessions(events: DataFrame, arm: str, step: str, session: str, steps: list[str], count_unknown: bool = False) -> DataFrame:
    """A row for each arm, a column for each step of the fixed list: different sessions. Steps nobody reached are 0.

    Unknown sessions are left out; count_unknown counts all of them as one. One pass, one shuffle of partial sets.
    """
    seen = F.countDistinct(session)
    if count_unknown:
        seen = seen + F.max(F.col(session).isNull().cast("int"))
    wide = events.filter(F.col(arm).isNotNull()).groupBy(arm).pivot(step, steps).agg(seen)
    return wide.na.fill(0, steps)


def rates(counts: DataFrame, pairs: dict[str, tuple[str, str]], base: str) -> DataFrame:
    """Percentages step/earlier step, 0 where the earlier one is 0; arms whose base is 0 are left out."""
    return counts.filter(F.col(base) > 0).withColumns({name: ratio(F.col(a).cast("double"), F.col(b), 100.0) for name, (a, b) in pairs.items()})


def first_of_each(events: DataFrame, by: list[str], order: list[str], exempt=None) -> DataFrame:
    """First event of each key; rows where `exempt` holds all stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    keep = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    first = events.filter(~keep).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first if exempt is None else first.unionByName(events.filter(keep))


def split_private(events: DataFrame, private: str, marker: str = "captured") -> tuple[DataFrame, DataFrame]:
    """(events with the private column turned into a flag, private values apart): they are written to different places and never joined again."""
    public = events.withColumn(marker, F.col(private).isNotNull()).drop(private)
    return public, events.filter(F.col(private).isNotNull())


def private_text(rows: DataFrame, text: str, pattern: str, marker: str) -> DataFrame:
    """rows with the text's private parts replaced by a marker, and their number; what was private is not kept."""
    return rows.withColumns({"private": F.regexp_count(text, F.lit(pattern)).cast("long"), text: F.regexp_replace(text, pattern, marker)})


def rota(rows: DataFrame, key: str, arms: int = 2, variants: int = 4) -> DataFrame:
    """rows with arm_order and variant by their rank: counterbalanced whatever the keys."""
    numbered = batch_numbers(rows, key, 1)
    return numbered.withColumns({"arm_order": F.col("batch") % arms, "variant": F.col("batch") % variants}).drop("batch")


def dwell(samples: DataFrame, by: list[str], at: str, state: str, close=None) -> DataFrame:
    """Seconds in each state: the time to the next sample is charged to the earlier state; close ends the last one."""
    w = Window.partitionBy(*by).orderBy(at)
    end = F.lead(at).over(w) if close is None else F.coalesce(F.lead(at).over(w), close)
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return samples.withColumn("__s", micros / 1e6).groupBy(*by, state).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("seconds"))
