import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), sum(gone), len(spans), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(r, n, alphabet="abé "):
    make = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [make(r.randint(10, 120)) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = make(r.randint(0, 150))
        for _ in range(r.choice([0, 1, 2])):
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(shared) + t[at:]
        texts.append(t)
    texts += [texts[1], texts[2] + "x", "a" * 300, "ab" * 200, "ab" * 40, None, "", shared[0], "c" * 41, "c" * 5]
    r.shuffle(texts)
    return texts


def test_common_prefixes():
    r = random.Random(1)
    for _ in range(80):
        text = np.array([r.choice([2, 3, 4]) for _ in range(r.randint(1, 60))] + [0])
        length = r.randint(1, 12)
        order, prefix = suffix.common_prefixes(text, length)
        tails = [text[i:].tolist() for i in order]
        for k in range(1, len(tails)):
            same = 0
            while same < min(len(tails[k]), len(tails[k - 1])) and tails[k][same] == tails[k - 1][same]:
                same += 1
            assert prefix[k] == (same if same < length else -1)


@pytest.mark.parametrize("most, longest", [(1 << 22, 1 << 16), (1 << 22, 7), (300, 64), (1, 1 << 16)])
def test_equal_to_brute_force(spark, monkeypatch, most, longest):
    """With all runs of a key together; with runs cut short; with large keys cut again; with digests for all."""
    monkeypatch.setattr(suffix, "MOST", most)
    monkeypatch.setattr(suffix, "LONGEST", longest)
    monkeypatch.setattr(suffix, "BLOCK", 500)
    texts = corpus(random.Random(7), 60)
    df = spark.createDataFrame([(None if i == 2 else i // 2, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid long, kept string")
    for length, gram in ((40, 8), (25, 25)):
        got = suffix.deduplicate(df, length, gram).collect()
        mine = Counter((r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
        assert mine == Counter(brute(texts, length))
    assert suffix.deduplicate(df.limit(0)).count() == 0


def test_whole_table_equal_to_a_count_of_all_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect()]
    got = Counter((r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix.deduplicate(docs).collect())
    assert got == Counter(brute(texts, 400)) and any(k[1] for k in got)


def passages(texts, length):
    """Texts without the words of strings of `length` words that are anywhere else too, each with the white space after it."""
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in folded]
    said = [[t[a:b] for a, b in w] for t, w in zip(folded, words)]
    seen = Counter(tuple(w[i : i + length]) for w in said for i in range(len(w) - length + 1))
    out = []
    for t, w, at in zip(texts, said, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        ends = [a for a, _ in at[1:]] + [len(t or "")]
        out.append(t if t is None else "".join([t[: at[0][0]] if at else t, *(t[at[k][0] : ends[k]] for k in range(len(at)) if k not in gone)]))
    return out


def test_passages_of_words_equal_to_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["a", "Bé", "über", "x", "y", "Z", "the", "of"]) + r.choice([" ", "  ", "\n", "\t "])
    shared = ["".join(word() for _ in range(r.randint(4, 30))) for _ in range(6)]
    texts = [None, "", " \n", "one", "a " * 60, "b " * 9] + ["".join(r.choice([word, lambda: r.choice(shared)])() for _ in range(r.randint(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(i % 7 or None, t, None, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, `a.b` string")
    for length, gram in ((10, 4), (6, 6)):
        got = suffix.shortened(df, length, gram)
        want = passages(texts, length)
        assert got.columns == df.columns
        assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter((i % 7 or None, t) for i, t in enumerate(want))
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        both = suffix.deduplicate(df, 40, 8, passage=length)
        assert Counter((x.n_bytes, x.passage_words) for x in both.collect()) == Counter((len((t or "").encode()), words(t) - words(w)) for t, w in zip(texts, want))
        changed = {w for t, w in zip(texts, want) if t != w}
        assert changed and all(x.n_chars == len(x.text) for x in got.collect() if x.text in changed and x.n_chars is not None)
    assert suffix.shortened(df.limit(0)).count() == 0


def test_rows_keep_their_numbers_in_other_splits(spark, tmp_path):
    """Scans are planned anew by each job; splits of another size must not move what is removed."""
    texts = corpus(random.Random(11), 200)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    ranges = suffix.duplicate_ranges(suffix._placed(docs), 40, 8)
    found = ranges.collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.minPartitionNum", "13")
        again = suffix._placed(docs)
        assert again.rdd.getNumPartitions() > 3
        got = {(x.rid, x.text) for x in again.select("rid", "text").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found and got == {(x.rid, x.text) for x in suffix._placed(docs).select("rid", "text").collect()} and len({g[0] for g in got}) == len(texts)
