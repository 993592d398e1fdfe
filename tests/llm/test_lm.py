import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lm
from ledgerline.llm.toxicity import fold_of


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


class Plain:
    """Context-tree weighting one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for known, context, bit in self.steps(t):
                for d in range(depth + 1):
                    self.n[known, context[len(context) - d :]][bit] += 1
                    if d < depth:
                        self.kids[known, context[len(context) - d :]].add(context[len(context) - d - 1 :])
        self.memo = {}

    def steps(self, t):
        data = b"\n" * self.depth + (" ".join(tokens(t)) + "\n").encode()
        for i in range(self.depth, len(data)):
            known = 1
            for b in range(7, -1, -1):
                bit = data[i] >> b & 1
                yield known, data[i - self.depth : i], bit
                known = known << 1 | bit

    def own(self, key):
        a, b = self.n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, key):
        if key not in self.memo:
            if len(key[1]) == self.depth:
                self.memo[key] = self.own(key)
            else:
                self.memo[key] = float(np.logaddexp(self.own(key), sum(self.weighted((key[0], c)) for c in self.kids[key]))) - math.log(2)
        return self.memo[key]

    def one(self, known, context, d=0):
        key = known, context[len(context) - d :]
        if key not in self.n:
            return None
        a, b = self.n[key]
        p = (b + 0.5) / (a + b + 1)
        below = self.one(known, context, d + 1) if d < self.depth else None
        if below is None:
            return p
        stop = math.exp(self.own(key) - math.log(2) - self.weighted(key))
        return stop * p + (1 - stop) * below

    def score(self, t):
        total = 0.0
        for known, context, bit in self.steps(t):
            p = self.one(known, context)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total


TEXTS = ["the cat sat on the mat", "The  cat\nsat", None, "", "  ", "a dog, a cat; the end", "straße é é", "the cat sat on the mat", "zzzz zq", "\x00\x1f odd \x0b bytes", "unseen words only here"] * 2


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_equal_to_plain_context_tree_weighting(spark, depth):
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, rid long, word string")
    learn = F.col("doc_id") % 3 != 1
    got = {r.doc_id: r for r in lm.scores(df, learn, depth=depth).collect()}
    train = [t for i, t in enumerate(TEXTS) if i % 3 != 1]
    plain = Plain(train, depth)
    counts = Counter(w for t in train for w in [*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(TEXTS):
        want = [*tokens(t), "\n"]
        assert got[i].n_tokens == len(want) and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in want)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in want))
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-4)
        assert got[i].n_bytes == len(" ".join(tokens(t)).encode()) + 1


@pytest.mark.parametrize("depth, most", [(0, 5), (1, 0), (2, 20), (4, 100), (4, 0)])
def test_rare_grams_meet_all_nodes(spark, monkeypatch, depth, most):
    monkeypatch.setattr(lm, "BUCKET", 20)
    monkeypatch.setattr(lm, "TASKS", 3)
    monkeypatch.setattr(lm, "PLACES", (3, 2))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    learn = F.col("doc_id") % 3 != 1
    assert len(lm.fit(df.filter(learn), depth, most).codes) <= most
    plain = Plain([t for i, t in enumerate(TEXTS) if i % 3 != 1], depth)
    got = {r.doc_id: r.score for r in lm.scores(df, learn, depth=depth, most=most).collect()}
    assert got == pytest.approx({i: plain.score(t) for i, t in enumerate(TEXTS)}, rel=1e-4)


def test_scorer_finds_every_gram():
    r = np.random.default_rng(5)
    codes = np.unique(r.integers(0, 1 << 48, 3000, np.uint64))
    r.shuffle(codes)
    values = r.random(len(codes))
    for places in ((12, 10), (4, 3), (16, 16)):
        scorer = lm.Scorer(codes, values, places)
        assert (scorer(codes) == values).all() and np.isnan(scorer(codes + np.uint64(1 << 50))).all()
    assert np.isnan(lm.Scorer(codes[:0], values[:0], (3, 3))(codes)).all()


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 0.2)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    a = sorted(map(tuple, lm.scores(df, F.lit(True), depth=2).select("doc_id", "n_known", F.round("base_score", 9)).collect()))
    monkeypatch.setattr(lm, "FREQUENT", 0.0)
    assert a == sorted(map(tuple, lm.scores(df, F.lit(True), depth=2).select("doc_id", "n_known", F.round("base_score", 9)).collect()))


def test_probabilities_add_up_to_one():
    code = np.frombuffer(b"abracadabra abracadabra", np.uint8).astype(np.uint64)
    grams = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:]
    levels = {}
    for d, node, n0, n1, _, stop in lm.subtree(grams, np.ones(len(grams), np.int64), 2, 0):
        levels[d] = (node, (n1 + 0.5) / (n0 + n1 + 1), stop)
    model = lm.Model(2, [levels[0], levels[1], levels[2]])
    for context in (b"ab", b"ra", b"zz"):
        all_bytes = np.uint64(context[0] << 16 | context[1] << 8) | np.arange(256, dtype=np.uint64)
        assert (10 ** model.log10(all_bytes)).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_empty_and_unlearned(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert lm.scores(df.limit(0), F.lit(True)).count() == 0
    got = {r.doc_id: r for r in lm.scores(df, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(4 * 8 * math.log10(0.5)) and got[1].train_tokens == 0 and got[1].n_known == 0
    assert got[1].base_score == pytest.approx(0) and got[None].n_tokens == 1


def test_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm.scores(docs, fold_of(10) != 0).filter(fold_of(10) == 0).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_short_slices_and_long_texts_change_nothing(spark, monkeypatch):
    long = " ".join(f"Wörd{i % 700} THE" for i in range(9000))
    rows = [*enumerate(TEXTS), (100, long), (101, long.upper()), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {}
    counts = Counter(w for i, t in rows if i % 3 != 1 for w in [*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = [*tokens(t), "\n"]
        want[i] = (len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    scores = []
    for size in (64, 1 << 22):
        monkeypatch.setattr("ledgerline.llm.textarrays.SLICE_BYTES", size)
        got = {r.doc_id: r for r in lm.scores(df, F.col("doc_id") % 3 != 1, depth=2).collect()}
        for i, (size_, known, base) in want.items():
            assert (got[i].n_tokens, got[i].n_known) == (size_, known) and got[i].base_score == pytest.approx(base)
        scores.append([got[i].score for i in want])
    assert scores[0] == pytest.approx(scores[1])
