"""Proportions, agreement and verdict arithmetic as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96  # Fixed value: normal quantile of a 95 % interval.


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """p, low, high of the Wilson score interval; (0, 0, 0) where n is 0; clamped to [0, 1]."""
    n = n.cast("double")
    p = F.coalesce(F.try_divide(k.cast("double"), n), F.lit(0.0))
    spread = 1 + F.coalesce(F.try_divide(F.lit(z * z), n), F.lit(0.0))
    centre = p + F.coalesce(F.try_divide(F.lit(z * z / 2), n), F.lit(0.0))
    inner = F.coalesce(F.try_divide(p * (1 - p), n), F.lit(0.0)) + F.coalesce(F.try_divide(F.lit(z * z / 4), n * n), F.lit(0.0))
    half = z * F.sqrt(inner)
    none = n == 0
    low = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / spread))
    high = F.when(none, 0.0).otherwise(F.least(F.lit(1.0), (centre + half) / spread))
    return p, low, high


def proportion(k: Column, n: Column, threshold: Column | float) -> dict[str, Column]:
    """p, low, high, verdict and inconclusive; resolved says NO DATA without rows and INCONCLUSIVE where the interval spans the threshold."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    p, low, high = wilson(k, n)
    verdict = F.when(p >= threshold, "PASS").otherwise("FAIL")
    spans = (n > 0) & (low < threshold) & (threshold < high)
    return {"p": p, "low": low, "high": high, "verdict": verdict, "inconclusive": spans, "resolved": F.when(n == 0, "NO DATA").when(spans, "INCONCLUSIVE").otherwise(verdict)}


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two labels, pairs with a blank side left out: n, observed, expected, kappa (NULL without pairs, 1 where all agree by chance)."""
    by = by or []
    side = lambda c: F.trim(F.col(c).cast("string"))
    pairs = df.select(*by, side(a).alias("__a"), side(b).alias("__b")).filter("coalesce(__a, '') != '' and coalesce(__b, '') != ''")
    cells = pairs.groupBy(*by, "__a", "__b").agg(F.count("*").alias("c"))
    stacked = cells.select(*by, "c", (F.col("__a") == F.col("__b")).alias("same"), F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("__a").alias("label")), F.struct(F.lit("b").alias("side"), F.col("__b").alias("label")))))
    margins = stacked.groupBy(*by, "label").agg(F.sum(F.when(F.col("side") == "a", F.col("c")).otherwise(0)).alias("ca"), F.sum(F.when(F.col("side") == "b", F.col("c")).otherwise(0)).alias("cb"), F.sum(F.when((F.col("side") == "a") & F.col("same"), F.col("c")).otherwise(0)).alias("agree"))
    whole = margins.groupBy(*by).agg(F.sum("ca").alias("n"), F.sum("agree").alias("agree"), F.sum(F.col("ca") * F.col("cb")).alias("cross"))
    n = F.col("n").cast("double")
    observed, expected = F.try_divide(F.col("agree"), n), F.try_divide(F.col("cross"), n * n)
    value = F.when(expected >= 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return whole.select(*by, F.coalesce("n", F.lit(0)).alias("n"), observed.alias("observed"), expected.alias("expected"), value.alias("kappa"))


def kappa_band(k: Column) -> Column:
    return F.when(k.isNull(), "NO DATA").when(k < 0.4, "poor").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("strong")


def projected_seconds(items: str, seconds: str, to: int = 100_000) -> tuple[Column, Column]:
    """Aggregates: seconds for `to` items at the median rate of usable rows, and the largest measured run."""
    usable = (F.col(items) > 0) & (F.col(seconds) > 0)
    rate = F.median(F.when(usable, F.col(items) / F.when(F.col(seconds) > 0, F.col(seconds))))
    return F.try_divide(F.lit(float(to)), rate), F.max(F.when(usable, F.col(items)))
