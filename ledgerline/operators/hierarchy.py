"""Catalogues: paths, ancestors, de-duplicated roll-ups, leaf views, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import SEP, escape_html, slug


def flatten_tree(spark: SparkSession, tree: dict) -> DataFrame:
    """A nested dict as rows in pre-order: path, name, depth, is_leaf, also_in, icon, ordinal. Names starting with '_' are attributes."""
    rows: list[tuple] = []

    def walk(node: dict, above: tuple[str, ...]) -> None:
        for name, below in node.items():
            if name.startswith("_"):
                continue
            path, kids = (*above, name), [k for k in below if not k.startswith("_")]
            rows.append((SEP.join(path), name, len(path), not kids, below.get("_also_in"), below.get("_icon"), len(rows)))
            walk(below, path)

    walk(tree, ())
    return spark.createDataFrame(rows, "path string, name string, depth int, is_leaf boolean, also_in array<string>, icon string, ordinal int")


def ancestors(path: Column) -> Column:
    """The path itself and all paths above it, shortest first."""
    parts = F.split(path, SEP)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEP))


def with_path(paths: Column, path: Column) -> Column:
    """paths with path at the end unless it is there; order kept."""
    return F.array_union(paths, F.array(path))


def entries(assets: DataFrame, id_column: str, paths: str) -> DataFrame:
    """One row for each asset and path: the inverted index, not yet gathered."""
    return assets.select(id_column, F.explode(paths).alias("path"))


def roll_up(index: DataFrame, id_column: str, nodes: DataFrame | None = None) -> DataFrame:
    """path, assets (different ids at or below it), entries. An asset in several branches of a node counts there once.

    Prefix matching becomes an equi-aggregate: every entry is given to each of its ancestors. With nodes, each of
    their paths has a row, 0 if empty, and no other path has.
    """
    up = index.select(id_column, F.explode(ancestors(F.col("path"))).alias("path"))
    got = up.groupBy("path").agg(F.countDistinct(id_column).alias("assets"), F.count("*").alias("entries"))
    return got if nodes is None else nodes.join(got, "path", "left").na.fill(0, ["assets", "entries"])


def leaf_view(index: DataFrame, order: list[Column], n: int = 24) -> DataFrame:
    """The first n rows of every path in the given order, their rank, and how many more there are."""
    w = Window.partitionBy("path").orderBy(*order)
    sizes = index.groupBy("path").agg(F.count("*").alias("__size"))
    top = index.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.join(sizes, "path").withColumn("more", F.greatest(F.col("__size") - n, F.lit(0))).drop("__size")


def invalid_paths(index: DataFrame, leaves: DataFrame) -> DataFrame:
    """Paths that are no valid leaf, with their number of entries, most first."""
    return index.join(leaves.select("path"), "path", "left_anti").groupBy("path").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "path")


def group_members(assets: DataFrame, id_column: str, groups: list[str]) -> DataFrame:
    """Members of every group; an asset can be in one group of each kind."""
    named = F.filter(F.array(*(F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("name")) for g in groups)), lambda x: x["name"].isNotNull())
    return assets.select(id_column, F.inline(named)).groupBy("kind", "name").agg(F.sort_array(F.collect_list(id_column)).alias("members"), F.count("*").alias("n"))


def unreachable(targets: DataFrame, view: DataFrame, id_column: str) -> DataFrame:
    """Targets (path, id) that the view of their path doesn't show; must be empty."""
    return targets.join(view.select("path", id_column), ["path", id_column], "left_anti")


def weighted_buckets(shares: dict[str, float], total: int) -> dict[str, int]:
    """max(1, round(share * total)) each, cut off at total in the order given."""
    out, left = {}, total
    for name, share in shares.items():
        out[name] = min(left, max(1, round(share * total)))
        left -= out[name]
    return out


def generate_library(spark: SparkSession, n: int, shares: dict[str, float], salt: int = 7) -> DataFrame:
    """A deterministic asset table: id, path by weighted bucket, a day of capture, enrichment paths by hash thresholds."""
    bounds, up = [], 0
    for name, count in weighted_buckets(shares, n).items():
        up += count
        bounds.append((name, up))
    path = F.coalesce(*(F.when(F.col("id") < b, F.lit(name)) for name, b in bounds), F.lit(bounds[-1][0]))
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(salt + k)), F.lit(10_000)) / 10_000
    day = F.date_sub(F.to_date(F.lit("2026-08-22")), F.floor(draw(1) * 1500).cast("int"))
    base = spark.range(n).select("id", path.alias("primary"), day.alias("captured_on"))
    paths = F.array(F.col("primary"), F.concat(F.lit("Timeline" + SEP), F.year("captured_on").cast("string")))
    paths = F.when(draw(2) < 0.22, F.array_union(paths, F.array(F.lit("Work" + SEP + "General")))).otherwise(paths)
    return base.withColumn("paths", paths)


def lookup(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths (path) with their node's name, depth and is_leaf; unknown paths stay with NULLs."""
    return paths.join(nodes.select("path", "name", "depth", "is_leaf"), "path", "left")


def first_targets(targets: DataFrame, task: str, order: list[str]) -> DataFrame:
    """The first row of every task."""
    others = [c for c in targets.columns if c != task]
    return targets.groupBy(task).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__t")).select(task, *(F.col(f"__t.{c}").alias(c) for c in others))


def target_ids(targets: DataFrame, task: str, id_column: str, order: str) -> DataFrame:
    """task, position (from 1), id in order of insertion: the list of each task's ids as rows, so that no list has to fit into a task."""
    w = Window.partitionBy(task).orderBy(order, id_column)
    return targets.select(task, F.row_number().over(w).alias("position"), id_column)


def placed(assets: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """assets with the country, city and coordinates of their place key; an unknown key stays with NULLs."""
    return assets.join(places, key, "left")


def library_scan(assets: DataFrame, at: str, id_column: str, hidden: Column, newest: int | None = None, first: int | None = None) -> DataFrame:
    """Assets that are not hidden, oldest first; or only the newest, newest first, or the first ones. Ties go by id."""
    shown = assets.filter(~F.coalesce(hidden, F.lit(False)))
    if newest is not None:
        return shown.orderBy(F.desc(at), id_column).limit(newest)
    ordered = shown.orderBy(at, id_column)
    return ordered if first is None else ordered.limit(first)


def valid_paths(leaves: DataFrame, years: range, root: str = "Timeline") -> DataFrame:
    """Leaves and the timeline's years, each once."""
    spark = leaves.sparkSession
    line = spark.range(years.start, years.stop).select(F.concat(F.lit(root + SEP), F.col("id").cast("string")).alias("path"))
    return leaves.select("path").union(line).distinct()


def synthetic_assets(spark: SparkSession, n: int, text_share: float) -> DataFrame:
    """id, has_text: of every hundred ids the first text_share hundredths hold text."""
    return spark.range(n).select("id", (F.pmod("id", F.lit(100)) < 100 * text_share).alias("has_text"))


def page_html(view: DataFrame, id_column: str) -> DataFrame:
    """path, html: a catalogue page for each path of a leaf view (at most the view's n rows a path), its assets in rank order."""
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col(id_column).cast("string").alias("id"))))
    pages = view.groupBy("path").agg(rows.alias("r"), F.max("more").alias("more"))
    items = F.array_join(F.transform("r", lambda x: F.concat(F.lit("<li>"), escape_html(x["id"]), F.lit("</li>"))), "")
    more = F.when(F.col("more") > 0, F.concat(F.lit("<p>"), F.col("more").cast("string"), F.lit(" more</p>"))).otherwise(F.lit(""))
    return pages.select("path", F.concat(F.lit("<h1>"), escape_html(F.col("path")), F.lit("</h1><ol>"), items, F.lit("</ol>"), more).alias("html"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """One folder for each path's slug with its page."""
    pages.select(slug(F.col("path")).alias("slug"), F.col("html").alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)
