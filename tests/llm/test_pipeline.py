import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerline.llm import suffix
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_similar import brute as one_of_each
from tests.llm.test_suffix import passages

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, rows(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    out = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    first = rows(out)
    assert out.columns == columns and set(first) <= set(given) and len(first) >= 0.75 * len(given)

    out = corpus_pipeline.STAGES[1][1](spark, out, SF)
    second = rows(out)
    assert out.columns == columns and second == [first[i] for i in one_of_each([r[:2] for r in first])]

    out = corpus_pipeline.STAGES[2][1](spark, out, SF)
    third = rows(out)
    want = passages([r[1] for r in second], 50)
    assert out.columns == columns and third == [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in zip(second, want)]

    out = corpus_pipeline.STAGES[3][1](spark, out, SF)
    fourth = rows(out)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in leaks([r[:2] for r in third], items)}
    assert bad and out.columns == columns and fourth == [r for r in third if r[0] not in bad]

    packed = corpus_pipeline.STAGES[4][1](spark, out, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in fourth} and all(r.n == r.m for r in packed)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "start", "length", "ids"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect()))


def test_split_characters_are_dropped(spark):
    text = "é" * 30
    df = spark.createDataFrame([(1, "x" + text, "a", 3), (2, "é" + "yx" + text, "b", 4)], "doc_id long, text string, kept string, n_chars int")
    got = {r.doc_id: r for r in suffix.shortened(df, length=20, gram=5, unit="byte").collect()}
    for i, t in ((1, "x" + text), (2, "é" + "yx" + text)):
        assert re.fullmatch("é?y?", got[i].text) and got[i].n_chars == len(got[i].text) and t


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing names, an empty table."""
    long = " ".join(f"Wort{i}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "pq")
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, " \n", "en", "s", 2), (2, long, "en", "s", len(long)), (3, f"{one} {passage} b", None, "s", 3), (4, f"{passage} {other}", "en", "s", 4), (5, "one clean line of words", "en", "s", 5), (5, "one clean line of words", "en", "s", 5), (6, f"see {item} there", "en", "s", 6)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `rid.text` string")
    kept = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        counts.append(kept.count())
    assert counts == [9, 6, 6, 5]
    texts = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert texts == [(1, min("", " \n", key=lambda t: zlib.crc32(t.encode()))), (2, long), (3, f"{one} b"), (4, other), (5, "one clean line of words")]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {1, 2, 3, 4, 5}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0
