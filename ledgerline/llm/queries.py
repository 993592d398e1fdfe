"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.ann import nearest
from ledgerline.llm.decontaminate import leaks
from ledgerline.llm.feistel import materialise
from ledgerline.llm.lm import scores
from ledgerline.llm.packing import pack
from ledgerline.llm.quality import quality
from ledgerline.llm.simhash import hex_fingerprint, near_duplicates
from ledgerline.llm.storage import table
from ledgerline.llm.suffix import PASSAGE, deduplicate
from ledgerline.llm.token_counts import tiktoken_vocabulary, token_counts
from ledgerline.llm.toxicity import fold_of, toxicity


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tiktoken_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold_of(3) != 1)
    return scored.select("doc_id", (fold_of(3) == 1).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), learn=fold_of(10) != 0)
    return scored.withColumn("held_out", fold_of(10) == 0)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), passage=PASSAGE)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_words")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold_of(5) != 0)
    return scored.select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted", "evidence", "evidence_terms")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_lm": op5_lm,
    "op6_suffix_array": op6_suffix_array,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_training_order": op10_training_order,
}

ORACLE_SQL: dict[str, str] = {}
