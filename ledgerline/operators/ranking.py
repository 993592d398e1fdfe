"""Ranks, running totals and medians of whole tables without a task that sees all of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.storage import kept

PART = "__part"


def laid_out(df: DataFrame, *order: str) -> DataFrame:
    """df written once in range partitions of the order, with PART, the number of each row's partition: what counts the partitions and what numbers their rows must see the same ones."""
    return kept(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "laid-out")


def running(laid: DataFrame, by: list[str], order: list[str], weight: Column) -> DataFrame:
    """laid with total: the weights of the rows up to this one, in order, among the rows equal in `by` (nulls are equal).

    A partition's rows are added up in the partition; what lies before it is one sum for each partition and group.
    """
    sums = laid.groupBy(PART, *by).agg(F.sum(weight).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(PART, *by, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    before = before.toDF(*(f"__{c}" for c in before.columns))
    here = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = laid.withColumn("__here", F.sum(weight).over(here))
    same = reduce(lambda a, c: a & ranked[c].eqNullSafe(before[f"__{c}"]), [PART, *by], F.lit(True))
    return ranked.join(before, same).withColumn("total", F.col("__here") + F.col("____before")).drop(*before.columns, "__here")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the exact median of every group's values; nulls are left out, and so are groups without values.

    Equal values are counted before anything is shuffled whole; the one or two middle values are found by running totals.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__n"))
    laid = laid_out(counts, *by, "__value")
    totals = running(laid, by, ["__value"], F.col("__n"))
    sizes = laid.groupBy(*by).agg(F.sum("__n").alias("__all"))
    sizes = sizes.toDF(*(f"__{c}" for c in sizes.columns))
    same = reduce(lambda a, c: a & totals[c].eqNullSafe(sizes[f"__{c}"]), by, F.lit(True))
    placed = totals.join(sizes, same)
    first = F.col("total") - F.col("__n") + 1
    low, high = F.floor((F.col("____all") + 1) / 2), F.floor(F.col("____all") / 2) + 1
    middle = placed.filter((F.col("total") >= low) & (first <= high))
    return middle.groupBy(*by).agg(((F.min("__value") + F.max("__value")) / 2).alias("median"))
