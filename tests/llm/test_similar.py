import os
import random
import re
import time

import corpus_pipeline
import numpy as np

from ledgerline.llm import simhash, storage


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([" ".join(w)] if w else [])


def brute(rows, similarity=0.8):
    """Rows that stay, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a | sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append((d is None, d or 0, i))
    return sorted(min(g)[2] for g in best.values())


def planted(r):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(60):
        text = [r.choice(words) for _ in range(r.randint(60, 300))]
        rows.append((10 * d, " ".join(text)))
        if d % 2:
            for c in range(1, 4):
                near = list(text)
                for _ in range(max(1, len(near) // 60)):
                    near[r.randrange(len(near))] = r.choice(words)
                rows.append((10 * d + c, " ".join(near)))
    return rows


def test_stage_catches_planted_near_copies(spark):
    rows = planted(random.Random(1))
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    want = brute(rows)
    assert len(want) < len(rows) - 60
    assert sorted(r.n for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [rows[i][0] for i in brute(rows)]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_hamming_code_is_perfect():
    words = np.arange(128)
    home = simhash.hamming_home(words)
    assert np.bincount(home).tolist() == [8] * 16
    for i in range(16):
        mine = words[home == i]
        assert any((np.bitwise_count(mine ^ m) <= 1).all() for m in mine)


def test_pairs_at_the_threshold_meet():
    """Flipped bits as texts of similarity 0.8 have them: hardly any pair shares no anchor, whatever the number of codes."""
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (1500, simhash.WIDE // 8)).astype(np.uint8)
    b = a ^ np.packbits(r.random((1500, simhash.WIDE)) < 0.1515, axis=1)
    for classes, least in ((1 << 10, 0.97), ((1 << 20) + 1, 0.95)):
        tables = simhash.Tables(*simhash.tables_for(classes))
        assert (tables.keys(a) == tables.keys(b)).any(axis=1).mean() > least
        assert (tables.keys(a) == tables.keys(np.roll(b, 1, axis=0))).mean() < 1e-3


def test_meetings_link_rows_of_a_key_that_are_near():
    r = np.random.default_rng(1)
    key = np.sort(r.integers(0, 30, 400))
    centres = r.integers(0, 1 << 63, 4).astype(np.uint64)
    fp = centres[r.integers(0, 4, 400)][:, None] ^ (np.uint64(1) << r.integers(0, 64, (400, 2)).astype(np.uint64))
    at, to = simhash.meetings(key, fp)
    got = dict(zip(at.tolist(), to.tolist()))
    for i in range(400):
        near = [j for j in range(i) if key[j] == key[i] and sum(bin(int(x)).count("1") for x in fp[i] ^ fp[j]) <= simhash.NEAR]
        assert got.get(i) == (near[-1] if near else None)


def test_groups_of_hundreds_of_near_copies(spark):
    """One group holds most rows; a chain of edits makes its ends unlike."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    text = [r.choice(words) for _ in range(200)]
    rows = []
    for d in range(250):
        near = list(text)
        near[r.randrange(200)] = r.choice(words)
        rows.append((d, " ".join(near)))
        if d % 25 == 0:
            text = near
    rows += [(1000 + d, " ".join(r.choice(words) for _ in range(120))) for d in range(50)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    assert sorted(x.n for x in simhash.one_of_each(df).collect()) == brute(rows)


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    rows = [(1, long, "x", 1), (2, long + " more", "y", 2), (3, "short", "z", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, key long")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and {(x[0], x[2]) for x in got.collect()} == {(1, "x"), (3, "z"), (None, None)}


def test_null_and_repeated_ids_keep_one_row_of_each(spark):
    a, b, c = "one two three four five six", "other words that stand quite alone", "a clean text beside a copy"
    rows = [(None, a), (None, a), (5, b), (5, b), (3, a + " "), (7, b), (7, c), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    got = {r.n for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == {4, 2, 6, 7} == set(brute(rows))


def test_no_link_depends_on_the_fingerprints(spark, monkeypatch):
    """Pairs at the threshold, as near ones that unlike rows hide; then nothing that fingerprints find."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    line = [r.choice(words) for _ in range(12)]
    rows = []
    for d in range(700):
        n = r.choice([8, 17, 26, 35])  # shingles in both; a ninth of them are others, at the end
        text = (line if d % 3 == 0 else []) + [r.choice(words) for _ in range(n + 5)]
        n = len(text) - 4
        near = list(text)
        near[len(text) - n // 9 :] = [r.choice(words) for _ in range(n // 9)]
        rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(near))]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    want = brute(rows)
    assert len(want) < 800
    assert sorted(x.n for x in simhash.one_of_each(df).collect()) == want
    monkeypatch.setattr(simhash, "candidates", lambda classes: spark.createDataFrame([], "a long, b long, d int"))
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    assert sorted(x.n for x in simhash.one_of_each(df).collect()) == want


def test_pairs_across_roots_are_all_looked_at():
    r = np.random.default_rng(3)
    key = np.sort(r.integers(0, 20, 300))
    root = r.integers(0, 4, 300)
    order = np.lexsort((root, key))
    root, cls, n, place = root[order], r.permutation(300), r.integers(20, 26, 300), r.integers(0, 4, 300)
    got = {tuple(p) for pairs in simhash.across(key, root, cls, n, place, 0.8, most=50) for p in pairs.tolist()}
    fits = lambda i, j: min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and min(n[i] - place[i], n[j] - place[j]) * 1.8 >= 0.8 * (n[i] + n[j]) - 1e-9
    assert got == {(max(cls[i], cls[j]), min(cls[i], cls[j])) for i in range(300) for j in range(i) if key[i] == key[j] and root[i] != root[j] and fits(i, j)}


def test_few_tables_are_spread_at_once_and_nothing_stays(spark, monkeypatch):
    """With as many tables as 2**20 classes and more have: each is asked once, and neither shuffle files nor tables that nothing reads are left."""
    rows = planted(random.Random(3))
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    few = simhash.tables_for((1 << 20) + 1)
    assert few[1] > 2 * simhash.TABLES
    asked, found = [], simhash.candidates

    def candidates(classes, chosen=range(few[1]), *more):
        asked.append(chosen if more else range(simhash.FEW) if hasattr(simhash, "FEW") else chosen)
        return found(classes, chosen, *more) if more else found(classes)

    folder = storage.shared_dir(spark).removeprefix("file://")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    monkeypatch.setattr(simhash, "tables_for", lambda n: few)
    monkeypatch.setattr(simhash, "candidates", candidates)
    assert sorted(x.n for x in simhash.one_of_each(df).collect()) == brute(rows)
    assert max(map(len, asked)) <= 24 and sorted(t for chosen in asked for t in chosen) == list(range(few[1]))
    assert not {n.split("-")[0] for n in there() - before} & {"candidates", "sets", "roots", "remaining"}

    def files():
        return set(re.findall(r"shuffle_\d+_\S*?\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")))

    had, setting = files(), spark.conf.get(storage.CLEANUP, None)
    passing = storage.Passing(spark)
    counts = passing.saved(df.groupBy("doc_id").count(), "counts")
    until = time.time() + 10  # they are deleted in the background
    while files() - had and time.time() < until:
        time.sleep(0.1)
    assert files() <= had and counts.count() == len(rows) and spark.conf.get(storage.CLEANUP, None) == setting


def test_classes_of_one_component_are_not_met_again(spark):
    """A group of near copies that is known to be one component gives no pairs; two components of it only pairs across."""
    r = np.random.default_rng(11)
    centre = r.integers(0, 256, simhash.WIDE // 8).astype(np.uint8)
    rows = [(i, bytearray(centre ^ np.packbits(r.random(simhash.WIDE) < 0.02))) for i in range(200)]
    classes = spark.createDataFrame(rows, "cls long, wide binary")
    assert simhash.candidates(classes).count() > 200
    assert simhash.candidates(classes.selectExpr("cls", "wide", "0L as root")).count() == 0
    across = simhash.candidates(classes.selectExpr("cls", "wide", "cls div 100 * 100 as root")).collect()
    assert across and all(x.a >= 100 > x.b and x.d <= simhash.NEAR for x in across)
