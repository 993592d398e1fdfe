import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.llm import quality, toxicity
from ledgerline.llm.toxicity import Index, fold_of, isotonic, terms_of

ODD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 20_000), (None, "idiot"), (4, "Ä ö"), (5, "word " * 5000)]


def test_nearest_examples_equal_brute_force():
    r = np.random.default_rng(3)
    n, width = 500, 40
    dense = (r.random((n, width)) < 0.1) * r.integers(1, 5, (n, width))
    dense[7], dense[8] = dense[6], dense[6]
    row, term = np.nonzero(dense)
    idf = r.random(width) + 0.5
    index = Index(row, term, dense[row, term], idf, n)
    weight = np.where(dense > 0, (1 + np.log(np.maximum(dense, 1))) * idf, 0)
    unit = weight / np.maximum(np.sqrt((weight**2).sum(1)), 1e-12)[:, None]
    for i in range(60):
        t = np.flatnonzero(dense[i])
        if len(t):
            rows, cosine = index.nearest(t, dense[i, t], 10, but=i)
            exact = unit @ unit[i]
            exact[i] = 0
            best = np.lexsort((np.arange(n), -exact.round(12)))[:10]
            best = best[exact[best] > 0]
            assert rows.tolist() == best.tolist() and np.allclose(cosine, exact[best])


def test_terms_equal_plain_python():
    texts = ["The idiot, the IDIOT!", None, "", "worthless (worthless) Ärgerlich", "a b"]
    row, term, count, words = terms_of(pa.array(texts))
    got = Counter({(int(i), words[int(t)].as_py()): int(c) for i, t, c in zip(row, term, count)})
    want = Counter()
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            w = w.lower().strip(toxicity.PUNCTUATION)
            want.update([(i, w)] if w else [])
            want.update((i, w[:k] + "*") for k in toxicity.OPENINGS if len(w) > k)
    assert got == want


def test_isotonic_rises_and_stays_inside():
    r = np.random.default_rng(1)
    x = r.random(300)
    steps, values = isotonic(x, (r.random(300) < x).astype(int))
    assert (np.diff(values) > -0.2).all() and (np.diff(steps) > 0).all() and 0 < values.min() and values.max() < 1


def test_flattened_trees_equal_a_walk():
    r = np.random.default_rng(2)
    x = r.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    forest = quality.grow(x, y)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97
    for i in range(20):
        total = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(f[node] >= 0 and x[i, f[node]] > c[node])
            total += leaf[node - len(f)]
        assert np.isclose(forest.score(x[i : i + 1])[0], 1 / (1 + np.exp(-total)))
    assert np.allclose(quality.grow(x, np.ones(400)).score(x), 401 / 402)


def test_statistics_are_finite_for_odd_texts():
    got = quality.statistics(pa.array([t for _, t in ODD]))
    assert got.shape == (len(ODD), len(quality.NAMES)) and np.isfinite(got).all() and (got[0] == got[1]).all()


def held_out(spark, scored, label):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return {(r[label], r.predicted): r["count"] for r in scored.join(labels, "doc_id").groupBy(label, "predicted").count().collect()}


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = held_out(spark, quality.quality(docs, labels, fold_of(3) != 1).filter(fold_of(3) == 1), "quality")
    assert sum(n for (a, b), n in got.items() if a == b) >= 0.97 * sum(got.values())
    got = held_out(spark, toxicity.toxicity(docs, labels, fold_of(5) != 0).filter(fold_of(5) == 0), "toxic")
    assert got.get((1, 1), 0) >= 0.8 * (got.get((1, 1), 0) + got.get((1, 0), 0)) and got.get((0, 1), 0) <= 0.02 * got[0, 0]


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t, 1, 0.0) for i, t in ODD], "doc_id long, text string, y int, score double")
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 1, 1), (4, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.quality, toxicity.toxicity):
        for given in (labels, labels.limit(0)):
            got = score(docs, given, F.lit(True)).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_labels_outside_the_fold_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}" + (" idiot" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    b = a.withColumn("toxic", F.when(fold_of(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x, fold_of(5) != 0).collect()) for x in (a, b))
    assert one == two


def plain_statistics(t):
    t = t or ""
    raw = t.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    sizes = [len(w.encode()) for w in words]
    lines, n, w = t.split("\n"), len(raw), max(len(words), 1)
    times = Counter(words)
    mean = sum(sizes) / w
    share = lambda f: sum(map(bool, map(f, words))) / w
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *(sum(b in members for b in raw) / max(n, 1) for members in quality.CLASSES.values()),
        mean, max(sum(s * s for s in sizes) / w - mean**2, 0) ** 0.5, sum(s > 14 for s in sizes) / w, sum(s < 4 for s in sizes) / w, len(times) / w, max(times.values(), default=0) / w, sum(c for c in times.values() if c > 2) / w,
        len(set(lines)) / len(lines), n / len(lines), len(zlib.compress(raw, 1)) / max(n, 1), share(lambda x: re.search(r"^[A-Z]+[^a-z]*$", x)), share(lambda x: re.search(r"[!?]$", x)), share(lambda x: re.search(r"[0-9]", x)), share(lambda x: re.search(r"[#$%&*+/<=>@^_`{|}~]", x)),
    ]


def test_statistics_equal_plain_python():
    texts = [None, "", " \n", "One two two TWO two!\nline 2\n\nline 2", "Ärger über $5 <b>NOW</b>?", "a\tb\x0bc\r\nd", "extraordinarilylongword x " * 40, "no end"]
    got = quality.statistics(pa.array(["before", *texts]).slice(1))
    assert len(quality.NAMES) == got.shape[1]
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_statistics(t), atol=1e-6), (t, dict(zip(quality.NAMES, zip(row, plain_statistics(t)))))


def test_first_split_equal_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 1)
    r = np.random.default_rng(8)
    x = np.round(r.random((300, 4)), 2)
    y = ((x[:, 1] > 0.37) | (r.random(300) < 0.1)).astype(float)
    forest = quality.grow(x, y)
    p = 1 / (1 + np.exp(-forest.base))
    g, h = p - y, np.full(300, p * (1 - p))
    best = (0, None)
    for f in range(4):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= quality.LEAST_LEAF:
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
                best = max(best, (part(left) + part(~left) - g.sum() ** 2 / (h.sum() + quality.RIDGE), (f, c)), key=lambda b: b[0])
    assert (forest.feature[0, 0], forest.cut[0, 0]) == best[1]
    node = np.zeros(300, int)
    for _ in range(quality.DEPTH):
        f = forest.feature[0, node]
        node = 2 * node + 1 + ((f >= 0) & (x[np.arange(300), f] > forest.cut[0, node]))
    for leaf in np.unique(node):
        mine = node == leaf
        assert np.isclose(forest.leaf[0, leaf - forest.feature.shape[1]], -quality.RATE * g[mine].sum() / (h[mine].sum() + quality.RIDGE))


def test_votes_and_calibration_equal_brute_force():
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    held = [[w for w in words if r.random() < 0.3] for _ in range(60)]
    y = np.array([int("w0" in h or r.random() < 0.1) for h in held])
    row = np.repeat(np.arange(60), [len(h) for h in held])
    term = np.array([words.index(w) for h in held for w in h])
    idf = r.random(12) + 0.5
    model = toxicity.Model(words, idf, np.arange(100, 160), y, row, term, np.ones(len(row), np.int64))
    used = [i for i in range(60) if held[i]]
    unit = lambda h: {w: idf[words.index(w)] / sum(idf[words.index(v)] ** 2 for v in h) ** 0.5 for w in h}

    def vote(h, but=None):
        mine = unit(h)
        near = sorted(((round(sum(x * unit(held[i]).get(w, 0) for w, x in mine.items()), 12), -i) for i in used if i != but), reverse=True)
        near = [(c, -i) for c, i in near if c > 0][: toxicity.NEIGHBOURS]
        return (sum(c for c, i in near if y[i]) + 0.05) / (sum(c for c, _ in near) + 0.1), [100 + i for _, i in near[:5]]

    votes = [vote(held[i], i)[0] for i in used]
    steps, values = isotonic(np.array(votes), y[used])
    for h in ([], ["w0"], ["w0", "w3"], ["w5", "w7", "w1"], ["other"]):
        score, near, shared = model.score(pa.array([" ".join(h)]))
        known = [w for w in h if w in words]
        if not known:
            clean = [i for i in range(60) if not held[i]]
            assert np.isclose(score[0], (y[clean].sum() + 0.5) / (len(clean) + 1)) and not near[0]
            continue
        v, ids = vote(known)
        assert np.isclose(score[0], values[max(0, np.searchsorted(steps, v + 1e-12) - 1)], atol=1e-9) and near[0] == ids and sorted(shared[0]) == sorted(known)
