"""Keyed indexes: delta application, resume, batches, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import ranking


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of every key; of equal order a delete wins."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order), F.when(F.col("op") == "delete", 0).otherwise(1))
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace whole rows of index by key; later writes must not repeat a key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows.select(index.columns))


def apply_delta(index: DataFrame, changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """index after a delta (key, op in insert/update/delete): touched keys that still exist in current are taken anew, then deletes go. Applying it twice changes nothing."""
    touched = changes.filter(F.col("op").isin("insert", "update")).select(key).distinct()
    fresh = current.join(touched, key, "left_semi")
    gone = changes.filter(F.col("op") == "delete").select(key).distinct()
    return upsert(index, fresh, key).join(gone, key, "left_anti")


def resume(library: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not yet indexed."""
    return library.join(done.select(key), key, "left_anti")


def owned_delete(index: DataFrame, wanted: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """index without the wanted keys, but only those on the list of owned ones."""
    return index.join(wanted.select(key).join(owned.select(key), key, "left_semi").distinct(), key, "left_anti")


def batch_numbers(rows: DataFrame, key: str, size: int) -> DataFrame:
    """batch = rank of the key // size, for dense keys of any start and end; other columns stay. Equal keys rank in any order."""
    ranked = ranking.running(ranking.laid_out(rows, key), [], [key], F.lit(1))
    return ranked.withColumn("batch", F.floor((F.col("total") - 1) / size)).drop(ranking.PART, "total")


def run_flags(source: str = "delta_source") -> dict:
    """required_full_rescan: the change token had expired; the caller falls back to a full batch."""
    return {"required_full_rescan": F.coalesce(F.col(source) == EXPIRED, F.lit(False))}


# Where a run's delta came from.
FIRST, EXPIRED, CONTINUED = "first-run", "token-expired-full-rescan", "persistent-token"


def delta_since(changes: DataFrame, token: Column, oldest: Column, at: str = "seq") -> DataFrame:
    """changes after the token with their source. No token yet: no changes, and the caller keeps the newest `at` as its token. A token from before
    the oldest change still kept has expired: no changes either, and the run is flagged for a full rescan."""
    source = F.when(token.isNull(), FIRST).when(token < oldest, EXPIRED).otherwise(CONTINUED)
    return changes.withColumn("delta_source", source).filter((F.col("delta_source") == CONTINUED) & (F.col(at) > token)).withColumns(run_flags())


def delta_report(changes: DataFrame, token: Column, oldest: Column, at: str = "seq") -> DataFrame:
    """One row: delta_source, required_full_rescan, the ops counted and the token to keep, also where nothing is new."""
    source = F.when(token.isNull(), FIRST).when(token < oldest, EXPIRED).otherwise(CONTINUED)
    new = (source == CONTINUED) & (F.col(at) > token)
    count = lambda op: F.count_if(new & (F.col("op") == op)).alias(f"delta_{op}d" if op.endswith("e") else f"delta_{op}ed")
    got = changes.agg(count("insert"), count("update"), count("delete"), F.max(at).alias("token"))
    return got.withColumn("delta_source", source).withColumns(run_flags())


def token_age(token_at: Column, now: Column) -> Column:
    """Whole seconds since the token was taken; NULL without one."""
    return F.unix_timestamp(now) - F.unix_timestamp(token_at)


def flagged(assets: DataFrame, ids: DataFrame, key: str, name: str = "synthetic") -> DataFrame:
    """assets with a flag: the key is among ids. Both sides are dealt by key; a small side is broadcast by the optimizer's own size check."""
    marks = ids.select(F.col(key).alias("__id")).distinct()
    return assets.join(marks, F.col(key) == F.col("__id"), "left").withColumn(name, F.col("__id").isNotNull()).drop("__id")
