"""Lenient coercion of text columns: nothing here raises, whatever the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column | str, default: float | None = 0.0) -> Column:
    """Decimal text as double, anything else the default (None keeps NULL). Java suffixes such as 1d are not numbers."""
    c = F.col(c) if isinstance(c, str) else c
    got = F.when(c.cast("string").rlike(NUMBER), F.trim(c.cast("string")).try_cast("double"))
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def whole(c: Column | str) -> Column:
    """number(), truncated toward zero."""
    return number(c).cast("bigint")


def _word(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")))


def truthy(c: Column | str) -> Column:
    return _word(c).isin("true", "1", "yes")


def yes(c: Column | str) -> Column:
    """As truthy, but y counts too."""
    return _word(c).isin("y", "yes", "true", "1")


def arm(c: Column | str) -> Column:
    """Study arm: blank and unknown words fall to the baseline."""
    return F.when(_word(c).isin("b", "proto", "prototype"), "proto").otherwise("apple")


def blank(c: Column | str) -> Column:
    return _word(c) == ""


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b * scale, 0 where b is 0 or unknown."""
    return F.coalesce(F.try_divide(a * scale, b), F.lit(0.0))
