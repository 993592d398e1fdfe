"""Benchmark decontamination, in DataFrame operations alone.

A document's windows are as long in words as a benchmark item. Only windows that share a word shingle with an
item can have a similarity above zero, so windows are laid where a shingle of the item lies in the text, aligned
with it; nothing that could pass the last check is left out before it. Each window gets a 64-bit SimHash of its
shingles. Items of the same length are found by multi-index hashing: fingerprints are cut into radius + 1
blocks, and two within the radius agree on at least one block, so joining on (length, block, value) meets all
of them; the first block they agree on keeps a pair single. Pairs within the radius are then verified exactly:
weighted Jaccard similarity of the shingle multisets, at least `similarity`.

Only the benchmark's shingles and fingerprints are broadcast, in blocks of at most BROADCAST_SHINGLES rows: a
larger benchmark takes more passes, not more memory. Text is never shuffled; only windows that hold a shingle
of an item are, each once.

Words: runs of bytes other than 0x20 and 0x09-0x0D of the lower-cased text. Items of fewer than `words` words are
one shingle; a text shorter than an item is one window. Null, empty and blank texts and items match nothing, nor
does a null item_id. Repeated rows give one row; a null doc_id is a document like any other. An empty table on
either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WORDS, SIMILARITY = 5, 0.8
#: Differing bits of 64 that similar windows may have: at similarity 0.8 the mean is below 10 and 20 is over three standard deviations more.
RADIUS = 20
BROADCAST_SHINGLES = 500_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, also where the optimizer merges projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grams(words: str | Column, k: int) -> Column:
    """Hash of every run of k words, in order."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<long>"))


def _counted(grams: str) -> Column:
    """Hashes that tell repeats apart, so that multisets can be met as sets."""
    seen = F.transform(grams, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.transform(grams, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(seen)


def _simhash(grams: str) -> Column:
    def bit(b: Column) -> Column:
        ones = F.aggregate(grams, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)), F.lit(0).cast("long"))


def _masks(radius: int) -> list[int]:
    """radius + 1 blocks of bits as signed longs; the first ones are a bit wider."""
    n, masks, low = radius + 1, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        m = ((1 << width) - 1) << low
        masks.append(m - (1 << 64) if m >> 63 else m)
        low += width
    return masks


def _by_block(df: DataFrame, fp: str, masks: list[int]) -> DataFrame:
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    return df.select("*", F.posexplode(F.transform(table, lambda m: m.bitwiseAND(F.col(fp)))).alias("block", "value"))


FOUND = "doc_id long, copy long, bytes int, item_id long, similarity double, hamming int, start_word int"


def _found(docs: DataFrame, benchmark: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """A row for each window of a text and item it is like; copy and bytes name the text."""
    masks = _masks(radius)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.octet_length("text").alias("bytes"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("w")).filter(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    items = items.withColumn("m", F.size("w")).withColumn("k", F.least("m", F.lit(words)))
    sizes = items.groupBy("k").agg(F.sum(F.col("m") - F.col("k") + 1).alias("n")).collect()  # at most `words` rows
    if not sizes:
        return docs.sparkSession.createDataFrame([], FOUND)
    found = []
    for k, n in sorted(map(tuple, sizes)):
        passes = -(-n // BROADCAST_SHINGLES)
        of_size = items.filter(F.col("k") == k).withColumn("g", _grams("w", k))
        grams = text.select("doc_id", "copy", "bytes", _let(_words("text"), lambda w: _grams(w, k)).alias("g"))  # no filter on g: it would compute it again
        for p in range(passes):
            block = of_size.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
            found.append(_pass(grams, block, k, similarity, radius, masks))
    return reduce(DataFrame.union, found)


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, windows: one row for each document and item it holds."""
    pairs = _found(docs, benchmark, words, similarity, radius)
    best = F.max_by(F.struct("hamming", "start_word"), F.struct("similarity", -F.col("hamming"), -F.col("start_word")))
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("best"), F.count("*").alias("windows")).select("doc_id", "item_id", "similarity", "best.hamming", "best.start_word", "windows")


def _pass(text: DataFrame, items: DataFrame, k: int, similarity: float, radius: int, masks: list[int]) -> DataFrame:
    anchors = items.select("m", F.posexplode("g").alias("at", "gram")).distinct()
    laid = text.select("doc_id", "copy", "bytes", "g", F.posexplode("g").alias("here", "gram")).join(F.broadcast(anchors), "gram")
    grams = F.col("m") - (k - 1)
    start = F.greatest(F.lit(0), F.least(F.col("here") - F.col("at"), F.size("g") - grams))
    laid = laid.select("doc_id", "copy", "bytes", "m", start.alias("start_word"), "g", grams.alias("n"))
    windows = laid.select("doc_id", "copy", "bytes", "m", "start_word", F.slice("g", F.col("start_word") + 1, F.col("n")).alias("g")).dropDuplicates(["doc_id", "copy", "bytes", "m", "start_word"])
    windows = windows.select("doc_id", "copy", "bytes", "m", "start_word", _simhash("g").alias("fp"), _counted("g").alias("c"))
    targets = items.select("item_id", "m", _simhash("g").alias("item_fp"), _counted("g").alias("item_c"))
    keyed, held = _by_block(windows, "fp", masks), _by_block(targets, "item_fp", masks)
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.forall(F.slice(F.array(*(F.lit(x).cast("long") for x in masks)), F.lit(1), F.col("block")), lambda x: x.bitwiseAND(differ) != 0)
    common = F.size(F.array_intersect("c", "item_c"))
    alike = common / (F.size("c") + F.size("item_c") - common)
    meet = (F.col("item_block") == F.col("block")) & (held["value"] == keyed["value"]) & (held["m"] == keyed["m"])
    near = keyed.join(F.broadcast(held.withColumnRenamed("block", "item_block")), meet & (F.bit_count(differ) <= radius) & first & (alike >= similarity))
    return near.select("doc_id", "copy", "bytes", "item_id", alike.alias("similarity"), F.bit_count(differ).alias("hamming"), "start_word")


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their ids: whether a row goes depends on its text alone. Null texts stay."""
    text = docs.select(F.lit(None).cast("long").alias("doc_id"), docs["text"])
    held = _found(text, benchmark, words, similarity, radius).select(F.col("copy").alias("__copy"), F.col("bytes").alias("__bytes")).distinct()
    return docs.join(held, (F.xxhash64(docs["text"]) == F.col("__copy")) & (F.octet_length(docs["text"]) == F.col("__bytes")), "left_anti")
