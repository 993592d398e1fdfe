"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded, hashed sample on the driver; every vector is indexed, in the leaf it descends
to. A query goes down the tree best bin first: a priority queue holds the branches not yet taken, by distance
to their centroid, and leaves are visited in the order they come off it. How many leaves to visit is
calibrated: for a bounded set of indexed vectors the exact neighbours are found by a scan, and the visits are
widened until the share of those neighbours in the visited leaves reaches the recall asked for.

Equal vectors are one class that keeps its k + 1 smallest ids, which is all that any query can return of it, and
equal queries are searched once, so a vector that very many rows share is neither a hot key nor a square of
pairs. Leaves are dealt out as sub-buckets of bounded size, queries are sent to all of a leaf's sub-buckets, and
only the k + 1 best of each come back. A query's first leaves, about the square root of their number, are visited
before the others: the distance found there bounds what the others need to send.

Measure: Euclidean distance in double precision on the vectors as given; ties go to the smaller id. Null, empty
or zero vectors, and vectors with null or non-finite components, take no part, nor do null ids or vectors of
another length than the most common one. A repeated (id, vector) counts once; rows of the query's own id are
never its neighbours. Fewer candidates than k give fewer rows; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.storage import saved

SAMPLE = 32_768  # vectors the tree is fitted on
CALIBRATION = 96  # vectors whose exact neighbours are found
BRANCHES, LEAF, LEAST_SAMPLE = 12, 256, 8  # children a node, rows a leaf, sampled rows a leaf at least
SUB_BUCKET = 16_384  # rows of a leaf that one task holds
SCHEMA = "query long, distance double, ids array<long>"


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        at = _sq(x, centre).argmin(1)
        count = np.bincount(at, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, at, x)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
    return centre


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


class Tree:
    """Nodes with centroids; a node without children is a leaf, numbered in leaf."""

    def __init__(self, x: np.ndarray, leaf_rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.centre: list[np.ndarray] = [x.mean(0) if len(x) else np.zeros(x.shape[1])]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centre = _kmeans(x[rows], min(BRANCHES, -(-len(rows) // leaf_rows)), rng)
            at = _sq(x[rows], centre).argmin(1)
            parts = [rows[at == k] for k in range(len(centre))]
            if sum(len(p) > 0 for p in parts) < 2:
                continue
            for k, part in enumerate(parts):
                if len(part):
                    self.children[node].append(len(self.centre))
                    todo.append((len(self.centre), part))
                    self.centre.append(centre[k])
                    self.children.append([])
        self.points = np.array(self.centre)
        self.leaf = np.full(len(self.points), -1)
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (open_ := np.flatnonzero(self.leaf[node] < 0)).size:
            for n in np.unique(node[open_]):
                rows = open_[node[open_] == n]
                kids = np.array(self.children[n])
                node[rows] = kids[_sq(x[rows], self.points[kids]).argmin(1)]
        return self.leaf[node]

    def visits(self, x: np.ndarray, most: int) -> list[int]:
        """The first leaves that the best-bin-first walk of one vector comes to."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                gap = ((self.points[kids] - x) ** 2).sum(1)
                best = int(gap.argmin())
                for k, kid in enumerate(kids):
                    if k != best:
                        heapq.heappush(queue, (float(gap[k]), kid))
                node = kids[best]
            out.append(int(self.leaf[node]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v: the rows that take part, each (id, v) once."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).distinct()


def _best(query: np.ndarray, base: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of base nearest to one query, by exact distance and then smallest id."""
    rough = (base * base).sum(1) - 2 * (base @ query)
    if len(rough) > k:
        limit = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(limit) + float(query @ query)))
    else:
        near = np.arange(len(rough))
    exact = np.sqrt(((base[near] - query) ** 2).sum(1))
    order = np.lexsort((first[near], exact))[:k]
    return near[order], exact[order]


def nearest(base: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 10, recall: float = 0.97) -> DataFrame:
    """query_id, rank, id, score: for each row of queries its k nearest of the rows of base with another id."""
    spark = base.sparkSession
    rows = usable(base, id_column, vector_column)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    same = F.size("v") == common.d
    keep = k + 1
    ranked = rows.filter(same).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= keep)
    classes = saved(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")

    n = classes.count()
    sample = _matrix(pa.Table.from_batches(classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow().to_batches()).column("v"))
    tree = Tree(sample, max(LEAST_SAMPLE, LEAF * len(sample) // max(n, 1)))

    def index(batches):
        for b in batches:
            leaf = tree.assign(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), b.column("v"), b.column("ids")], names=["leaf", "v", "ids"])

    kind = classes.schema["v"].dataType.simpleString()
    indexed = saved(classes.mapInArrow(index, f"leaf int, v {kind}, ids array<long>"), "index")
    visits = calibrated(indexed, tree, sample[:: max(1, len(sample) // CALIBRATION)][:CALIBRATION], k, recall)
    sizes = dict(map(tuple, indexed.groupBy("leaf").count().collect()))  # one row a leaf
    subs = {leaf: -(-c // SUB_BUCKET) for leaf, c in sizes.items()}
    split = np.array([subs.get(i, 0) for i in range(tree.leaves)])

    asked = usable(queries, id_column, vector_column).filter(same)
    distinct = saved(asked.groupBy("v").agg(F.min("id").alias("query")), "queries")

    def probes(lo: int, hi: int):
        """Queries sent to the sub-buckets of their lo-th to hi-th leaf."""

        def send(batches):
            for b in batches:
                x = _matrix(b.column("v"))
                at, leaf, sub = [], [], []
                for i in range(len(x)):
                    for target in tree.visits(x[i], hi)[lo:]:
                        for s in range(split[target]):
                            at.append(i)
                            leaf.append(target)
                            sub.append(s)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(sub, pa.int32()), *(b.column(c).take(at) for c in ("query", "v", "most"))], names=["leaf", "sub", "query", "v", "most"])

        return send

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, y = _matrix(left.column("v")), _matrix(right.column("v"))
            ids = right.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            for q, v, most in zip(left.column("query").to_pylist(), x, left.column("most").to_pylist()):
                found += [(q, float(d), ids[r]) for r, d in zip(*_best(v, y, first, keep)) if d <= most]
        return pa.table({"query": pa.array([f[0] for f in found], pa.int64()), "distance": pa.array([f[1] for f in found], pa.float64()), "ids": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

    # a leaf that is not split has one sub-bucket; others are dealt by a hash of their smallest id
    table = F.array(*(F.lit(int(max(1, s))) for s in split)) if split.max(initial=1) > 1 else None
    sub = F.lit(0) if table is None else F.pmod(F.xxhash64(F.col("ids")[0]), F.element_at(table, F.col("leaf") + 1)).cast("int")
    held = indexed.withColumn("sub", sub)

    def visit(some: DataFrame, lo: int, hi: int) -> DataFrame:
        sent = some.mapInArrow(probes(lo, hi), f"leaf int, sub int, query long, v {kind}, most double")
        return sent.groupBy("leaf", "sub").cogroup(held.groupBy("leaf", "sub")).applyInArrow(compare, SCHEMA)

    def top(found: DataFrame) -> DataFrame:
        """The k + 1 best of each query."""
        near = Window.partitionBy("query").orderBy("distance", F.col("ids")[0])
        best = found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= keep).select("query", "distance", F.explode("ids").alias("id"))
        return best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).filter(F.col("r") <= keep)

    # the first leaves give a distance that the neighbours in all others must not exceed
    near = min(visits, math.isqrt(visits) + 1)
    found = saved(visit(distinct.withColumn("most", F.lit(float("inf"))), 0, near), "near")
    if near < visits:
        limit = top(found).filter(F.col("r") == keep).select("query", F.col("distance").alias("most"))
        found = found.union(visit(distinct.join(limit, "query", "left").select("v", "query", F.coalesce("most", F.lit(float("inf"))).alias("most")), near, visits))
    who = asked.join(distinct, "v").select(F.col("id").alias("query_id"), "query")
    own = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        who.join(top(found).select("query", "distance", "id"), "query").filter("id != query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("distance").alias("score"))
    )


def calibrated(indexed: DataFrame, tree: Tree, probe: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that, over the probe vectors, the recall is reached."""

    def scan(batches):
        best = [(np.empty(0), np.empty(0, np.int64))] * len(probe)
        for b in batches:
            x, leaf = _matrix(b.column("v")), b.column("leaf").to_numpy().astype(np.int64)
            gap = _sq(probe, x)
            for i in range(len(probe)):
                d, at = np.concatenate([best[i][0], gap[i]]), np.concatenate([best[i][1], leaf])
                near = np.argsort(d, kind="stable")[: k + 1]
                best[i] = d[near], at[near]
        for i, (d, at) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(d), pa.array(at)], names=["i", "gap", "leaf"])

    w = Window.partitionBy("i").orderBy("gap", "leaf")
    rows = indexed.select("v", "leaf").mapInArrow(scan, "i int, gap double, leaf long").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).toPandas()  # k + 1 rows a probe
    needed = []
    for i, group in rows.groupby("i"):
        order = {leaf: n for n, leaf in enumerate(tree.visits(probe[int(i)], tree.leaves), 1)}
        needed += [order[leaf] for leaf in group.sort_values("r")["leaf"].iloc[1:]]  # the first is the vector itself
    if not needed:
        return 1
    needed, visits = np.array(needed), 1
    while visits < tree.leaves and (needed <= visits).mean() < recall:
        visits = max(visits + 1, int(visits * 1.25))  # widened step by step
    return min(visits, tree.leaves)
