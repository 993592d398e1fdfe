import numpy as np

from ledgerline.llm import ann


def brute(rows, queries, k):
    out = {}
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    ids = [i for i, _ in fine]
    x = np.array([v for _, v in fine], np.float64)
    for q, v in fine:
        if q in queries:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            out[q] = sorted((dd, i) for dd, i in zip(d, ids) if i != q)[:k]
    return out


def test_exact_when_all_leaves_are_visited_with_hot_vector_and_odd_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    rows += [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [float("nan")] * 8), (2040, [None] * 8), (2050, [float("inf")] + [1.0] * 7), (2060, [1.0]), (None, [2.0] * 8), rows[10], rows[0]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query string, rank int")
    monkeypatch.setattr(ann, "SUB_BUCKET", 20)
    got = ann.nearest(df, df.filter("vec_id % 10 = 0"), "vec_id", "embedding", k=5, recall=1.1).collect()
    want = brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    assert {g.query_id for g in got} == set(want)
    for q, near in want.items():
        mine = sorted((g.rank, g.id, g.score) for g in got if g.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in near] and [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert np.allclose([m[2] for m in mine], [d for d, _ in near], rtol=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df, "vec_id", "embedding").count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for g in ann.nearest(df, df.filter("vec_id % 100 = 0"), "vec_id", "embedding").collect():
        got.setdefault(g.query_id, set()).add(g.id)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(best & got[q]), total + 10
    assert hits / total >= 0.9
