"""Cheap signals and the gate before costly stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate(screenshot: Column, width: Column, height: Column, score: Column) -> Column:
    """(run, reason): first rule that holds; bounds are strict; unknown or zero sizes skip the aspect rule."""
    aspect = F.try_divide(height.cast("double"), width)
    reason = (
        F.when(F.coalesce(screenshot, F.lit(False)), "screenshot-subtype")
        .when((width > 0) & (height > 0) & (aspect > 1.6) & (aspect < 2.4), "screen-aspect")
        .when(F.coalesce(score, F.lit(0.0)) > 0.55, "text-likelihood")
        .otherwise("gated-out")
    )
    return F.struct((reason != "gated-out").alias("run"), reason.alias("reason"))


def difference_hash(levels: Column, width: int = 9, height: int = 8) -> Column:
    """Bit set where a level exceeds its right neighbour, row by row; NULL for another number of levels. Bit-for-bit in a signed long."""
    steps = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    at = lambda i: (F.floor(i / (width - 1)) * width + i % (width - 1)).cast("int")
    bit = lambda i: F.when(F.get(levels, at(i)) > F.get(levels, at(i) + 1), F.lit(1)).otherwise(0).cast("bigint")
    return F.when(F.size(levels) == width * height, F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(i))))


def neighbour_hash(values: Column) -> Column:
    """The same fold over one row of values: a bit for each pair of neighbours, at most 64 of them."""
    n = F.least(F.size(values) - 1, F.lit(64))
    bit = lambda i: F.when(F.get(values, i) > F.get(values, i + 1), F.lit(1)).otherwise(0).cast("bigint")
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(i))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def chip(declared: Column, model: Column, known: dict[str, str]) -> Column:
    """Declared chip, else the one known for the device family, else '?'."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.nullif(F.upper(F.trim(declared)), F.lit("")), F.try_element_at(table, F.regexp_extract(model, r"(iPhone\d+)", 1)), F.lit("?"))


def rank(order: list[str], value: Column) -> Column:
    """Place in an ordered list, -1 if not in it."""
    return (F.array_position(F.array(*map(F.lit, order)), value) - 1).cast("int")


def metadata(created: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """Epoch seconds, coordinates and their confidence; unknown stays NULL, the compatibility form puts zeros."""
    fixed = lat.isNotNull() & lon.isNotNull()
    return {"created_at": F.coalesce(F.unix_timestamp(created), F.lit(0)), "lat": lat, "lon": lon, "loc_confidence": F.when(fixed, 1.0).otherwise(0.0)}


def degrees_minutes(value: Column) -> Column:
    """Absolute decimal degrees as whole degrees and minutes."""
    v = F.abs(value)
    return F.struct(F.floor(v).cast("int").alias("degrees"), ((v - F.floor(v)) * 60).alias("minutes"))


def hue(c: Column) -> Column:
    """Stable 0-359 from text."""
    return (F.conv(F.left(F.md5(c), F.lit(8)), 16, 10).cast("bigint") % 360).cast("int")
