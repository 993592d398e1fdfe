import random
import re
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.llm.components import components


def reference_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(fps):
    """Brute force: smallest id reachable."""
    n, part = len(fps), list(range(len(fps)))
    fp = np.array(fps, np.uint64)
    todo = True
    while todo:
        todo = False
        for i in range(n):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)
            low = min(part[j] for j in near)
            for j in near:
                if part[j] != low:
                    part[j], todo = low, True
    return part


def test_covering_loses_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 64, 300, np.uint64)
    near = base.copy()
    for k in range(300):
        for b in r.choice(64, k % 3, replace=False):
            near[k] ^= np.uint64(1 << int(b))
    anchors = simhash.Anchors(2)
    home = simhash.homes(base.view(np.int64), anchors)
    row, key = simhash.replicas(near.view(np.int64), anchors, 2)
    held = set(zip(row.tolist(), key.tolist()))
    assert all((i, int(home[i])) in held for i in range(300))
    assert len(held) == len(row)


def test_anchors_take_little_memory():
    """Each task makes them beside another one, on an executor whose heap leaves little room."""
    tracemalloc.start()
    try:
        anchors = simhash.Anchors(2)
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()
    words = np.random.default_rng(3).integers(0, 1 << simhash.BITS, 100_000)
    home = anchors.home(words)
    code = home << 11 ^ simhash.Anchors._mod(home << 11)
    assert np.bitwise_count(words ^ code).max() <= simhash.RADIUS and (anchors.syndrome(words) == simhash.Anchors._mod(words)).all()


def test_near_duplicates_equal_brute_force(spark):
    import duckdb

    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by 1 limit 700").fetchall()
    docs += [(900_000 + i, t) for i, t in enumerate(["", None, " \n", "a", "a b", "A  b"])]
    docs += [(950_000, docs[3][1]), (docs[5][0], docs[5][1])]
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, component_id long, fp string")
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex_fingerprint().alias("fp"), "component_id").collect()
    docs.sort(key=lambda x: x[0])
    fps = [reference_fp(t) for _, t in docs]
    want = sorted((i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, classes_of(fps)))
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_use_wider_counters():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 64, 70_000, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert int(simhash.majority(h, np.array([0, 70_000]))[1]) == want


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_table_is_gathered_on_the_driver(spark):
    """Out of one fingerprint come 61 replicas, which Spark does not know; link tables compress to next to nothing."""
    from ledgerline.llm import components as c
    from ledgerline.llm.storage import saved

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB")
    classes = saved(spark.range(1000).select((F.xxhash64("id")).alias("fp")), "classes")
    pairs = saved(spark.range(1000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v")), "links")
    for df in (simhash.links(classes), c._round(pairs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
