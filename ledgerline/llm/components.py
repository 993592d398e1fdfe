"""Connected components of a link table by alternating large-star and small-star steps.

Every round is written to the shared folder, so lineage stays short and lost executors cost one round. Stars
keep hub degrees in aggregates of the form min-per-node, which combine before the shuffle; no component is
ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import saved


def _hang(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u != v").distinct()


def _round(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _hang(both.filter("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    return _hang(large.hint("merge").join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """links: a, b long. node, root: root is the smallest node of the component; every linked node but the roots appears once."""
    e = saved(_hang(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, e = now, saved(_round(e), "links")
