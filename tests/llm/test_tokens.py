import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerline.llm import textarrays
from ledgerline.llm.feistel import Feistel, materialise, read_slots, stream, write_shards
from ledgerline.llm.packing import pack
from ledgerline.llm.token_counts import NONE, Automaton, tiktoken_vocabulary, token_counts
from ledgerline.llm.tokens import WordEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " \t\n", "Plain words, don't STOP!", "x" * 5000, "É é ÀB straße İI ﬁ é å", "<|endoftext|> a<|ENDOFTEXT|>b", "日本語 123 a1b2   nb sp \x1c", "it's we'LL 'tis", "🙂 a​b"]


def documents(spark, texts, extra=False):
    rows = [(None if i == 3 else i // 2, t, "text", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, slot long")
    return df if extra else df.select("doc_id", "text")


def test_fold_and_hash_match_plain_python():
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab c\nDE\t é") for _ in range(r.randint(0, 120))) for _ in range(300)]
    f = textarrays.fold(pa.array(texts).slice(1))
    for k in (1, 3, 5):
        start, size, runs = textarrays.word_runs(f, k)
        hashes, j = textarrays.xxh64(f.buf, start, size), 0
        for i, t in enumerate(texts[1:]):
            words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
            grams = [b" ".join(words[a : a + k]) for a in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
            assert len(grams) == runs[i]
            for g in grams:
                assert int(hashes[j]) == xxhash.xxh64_intdigest(g, seed=42)
                j += 1


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    import duckdb

    docs = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts = TEXTS + docs
    tokenizer = Tokenizer.from_file(WORD)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (600_000, 50):  # with words that are not remembered too
        monkeypatch.setattr("ledgerline.llm.tokens.REMEMBERED", most)
        encoder = WordEncoder(WORD)
        for _ in range(2):
            ids, counts = encoder.encode(pa.array(texts))
            ends = np.cumsum(counts)
            assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want


def test_word_encoder_cuts_as_the_tokenizer_does():
    r = random.Random(7)
    pieces = [*"aZ09.,'`<|>×÷ÀÞßþÿøÖ_~^&", "'s", "'LL", "'re", "<|", "<|endoftext|>", "\u212a", "\u212b", "e\u0301", "\u0301", "ẞ", "¡", "\x00", "\x1c", "\x7f", "½", "²", "ª", "日", "🙂", "\u00a0", "\u200b", " ", "\n"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 9))) for _ in range(4000)] + ["<", "|", "a< |b", "<|", "É", "ÉÀ é×é"]
    tokenizer, encoder = Tokenizer.from_file(WORD), WordEncoder(WORD)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for some in (slice(0, 2000), slice(1000, None)):
        ids, counts = encoder.encode(pa.array(texts[some]))
        assert [ids[e - c : e].tolist() for e, c in zip(np.cumsum(counts), counts)] == want[some]
    for blank in ([], [""], [None, " "]):
        ids, counts = encoder.encode(pa.array(blank, pa.string()))
        assert not len(ids) and counts.tolist() == [0] * len(blank)


def test_word_encoder_asks_the_model_once_for_each_part(monkeypatch):
    asked = []
    part = WordEncoder.part
    monkeypatch.setattr(WordEncoder, "part", lambda self, text: asked.append(text) or part(self, text))
    encoder = WordEncoder(WORD)
    for texts in (["Straße straße, STRASSE!", "cat Cat CAT cat, (cat)"], ["cat. cat-cat 'cat' cat7"]):
        encoder.encode(pa.array(texts))
    assert asked.count("cat") == 2  # the second for the quoted word, which is encoded whole
    assert asked.count("straße") == 1 and asked.count("7") == 1


def greedy(word: bytes, vocabulary: set[bytes]):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return NONE
        word, n = word[k:], n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    r = random.Random(5)
    for _ in range(60):
        vocabulary = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 25))}
        words = [bytes(r.choice(b"abcd" if r.random() < 0.1 else b"abc") for _ in range(r.randint(0, 14))) for _ in range(80)]
        off = np.cumsum([0, *map(len, words)])
        got = Automaton(list(vocabulary)).count(np.frombuffer(b"".join(words), np.uint8), off)
        assert got.tolist() == [greedy(w, vocabulary) for w in words]


def test_token_counts(spark):
    vocabulary = tiktoken_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = token_counts(documents(spark, TEXTS, extra=True), vocabulary).collect()
    known = set(vocabulary)
    want = []
    for t in TEXTS:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((len((t or "").encode()), len(words), sum(greedy(b" " + w, known) for w in words), 0))
    assert sorted(tuple(r[1:]) for r in got) == sorted(want)
    assert token_counts(documents(spark, TEXTS).limit(0), vocabulary).count() == 0


def test_pack_is_an_exact_cut(spark):
    texts = TEXTS + ["word " * 3000, "one"]
    rows = pack(documents(spark, texts, extra=True), WORD, seq_len=64).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts)
    docs, open_ = [], []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length == 1 << r.bucket <= 64 and r.offset == 0 and r.start == len(open_)
        open_ += ids
        if len(open_) == r.doc_tokens:
            docs.append(open_)
            open_ = []
    assert sorted(docs) == want and not open_
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert pack(documents(spark, TEXTS).limit(0), WORD).count() == 0


def test_pack_crc(spark):
    from pyspark.sql import functions as F

    for r in pack(documents(spark, TEXTS), WORD).withColumn("crc", F.crc32("ids")).collect():
        assert r.crc == zlib.crc32(r.ids)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = Feistel(n, 9)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and p.index(slots).tolist() == list(range(n))
    if n > 100:
        assert slots.tolist() != Feistel(n, 10).slot(np.arange(n)).tolist()


def test_materialise_holds_every_id_once(spark):
    texts = TEXTS + ["word " * 300, "one"]
    rows = materialise(documents(spark, texts, extra=True), WORD, seq_len=32, shard_rows=4).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 4 and r.byte_offset == r.slot % 4 * 64 and len(r.ids) == 64 for r in rows)
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts)
    assert sorted(i for r in rows for i in np.frombuffer(r.ids, "<u2")[: r.length].tolist()) == sorted(i for w in want for i in w)
    assert materialise(documents(spark, TEXTS).limit(0), WORD).count() == 0


def test_slots_are_the_same_under_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    of = lambda df: {(r.doc_id, r.start): r.slot for r in materialise(df, WORD, seq_len=64).select("doc_id", "start", "slot").collect()}
    want = of(docs)
    assert len(want) > 500
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert docs.rdd.getNumPartitions() > 3 and of(docs) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert of(docs.repartition(5)) == of(docs.repartition(3, "lang"))
    assert of(docs.repartition(5)) == want  # the table lies in order of doc_id


def test_slots_are_dealt_in_one_pass_to_even_runs_of_shards(spark):
    rows = materialise(documents(spark, ["word " * 300] * 40), WORD, seq_len=32, shard_rows=4, partitions=7)
    assert "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()  # its bounds are sampled, by a job that reads all rows
    parts = [[(r.slot, r.shard) for r in p] for p in rows.rdd.glom().collect()]
    n = sum(map(len, parts))
    assert n == 400 and len(parts) == 7
    assert [s for p in parts for s, _ in p] == list(range(n))
    shards = [sorted({k for _, k in p}) for p in parts]
    assert [k for p in shards for k in p] == list(range(100)) and {len(p) for p in shards} == {14, 15}


def test_shards_are_written_once_and_read_from_any_slot(spark, tmp_path):
    folder = f"file://{tmp_path}/order"
    rows = materialise(documents(spark, TEXTS + ["word " * 300], extra=True), WORD, seq_len=32, shard_rows=4)
    manifest = {r.shard: r for r in write_shards(rows, folder).collect()}
    want = {r.slot: r.ids for r in rows.collect()}
    assert sum(m["rows"] for m in manifest.values()) == len(want) and all(m.stride == 64 for m in manifest.values())
    for shard, m in manifest.items():
        data = (tmp_path / "order" / m.file).read_bytes()
        assert zlib.crc32(data) == m.crc32 and data == b"".join(want[s] for s in range(4 * shard, 4 * shard + m["rows"]))
    got = read_slots(folder, 5, 6, 4, 32)
    assert [r.tobytes() for r in got] == [bytes(want[s]) for s in range(5, min(11, len(want)))]
    rest = [(s + i, r.tobytes()) for s, ids in stream(folder, 3, 5, 4, 32) for i, r in enumerate(ids)]
    assert rest == [(s, bytes(want[s])) for s in range(3, len(want))]
    files = sorted((tmp_path / "order").glob("shard-*.bin"))
    kept = {f: f.stat().st_mtime_ns for f in files[1:]}
    files[0].unlink()
    write_shards(rows, folder)
    assert files[0].exists() and all(f.stat().st_mtime_ns == t for f, t in kept.items())


def test_ids_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="does not fit into 16 bits"):
        materialise(documents(spark, TEXTS), WORD, end_id=70_000).collect()
