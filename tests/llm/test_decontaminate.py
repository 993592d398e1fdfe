import random
import re
from collections import Counter


from ledgerline.llm import decontaminate as D


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def weighted(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 0


def brute(docs, items, k=5, least=0.8):
    """Every window of every document against every item."""
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for j, s in items:
            v = re.findall(r"[^\x20\x09-\x0D]+", (s or "").lower())
            if not v or j is None:
                continue
            g = min(k, len(v))
            target = grams(v, g)
            best = max((weighted(grams(w[a : a + len(v)], g), target) for a in range(max(1, len(w) - len(v) + 1))), default=0)
            if best >= least:
                out[i, j] = max(best, out.get((i, j), 0))
    return out


def test_equal_to_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([12, 30, 60, 60, 3, 1, 5, 80])] + [(20, None), (21, ""), (None, "w1 w2 w3"), (22, "a a a a a a a a b"), (0, "w0")]
    docs = []
    for d in range(120):
        w = text(r.randint(0, 120))
        if d % 3 == 0:
            _, s = items[r.randrange(8)]
            leak = s.split()
            for _ in range(r.choice([0, 0, 1])):
                leak[r.randrange(len(leak))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = leak
        docs.append((d, "  ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(500, None), (501, ""), (502, "a a a a a a a a a a a b"), (503, items[2][1]), (503, items[2][1]), (None, items[3][1]), (504, " ".join(items[7][1].split()[4:]))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id long, fp long")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(x.doc_id, x.item_id): x.similarity for x in D.leaks(df, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 0.12 and got[p] >= 0.8 for p in want)
    assert sum(abs(got[p] - want[p]) < 1e-12 for p in want) >= 0.95 * len(want)
    kept = D.clean(df, bench)
    bad = {t for n, (_, t) in enumerate(docs) if brute([(n, t)], items)}
    assert kept.columns == df.columns and sorted(map(repr, (r.text for r in kept.collect()))) == sorted(repr(t) for _, t in docs if t not in bad)


def test_a_row_goes_by_its_own_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, "clean words beside it", "a"), (1, f"so {item} it", "b"), (None, item, "c"), (None, "clean too", "d"), (2, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `copy.x` string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = D.clean(df, bench)
    assert got.columns == df.columns and sorted(r[2] for r in got.collect()) == ["a", "d", "e"]


def test_passes_do_not_change_the_result(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 300)
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == whole and whole


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench).count() == 1


def test_only_native_operations(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = D.leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_multi_index_blocks_cover_all_bits():
    masks = D._masks(D.RADIUS)
    assert len(masks) == D.RADIUS + 1 and sum(m & (2**64 - 1) for m in masks) == 2**64 - 1
