"""Registered queries of the training-data operators: one ``opN_<name>`` each,
with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, importance_resample, line_dedup, minhash_dedup, phrases, pii_tagger, quality_rules,
               relative_parse, secret_scan, source_mix, suffix_dedup, token_binary, url_filter)

URL_RULES = (url_filter.HostRule("net/", False), url_filter.HostRule("example.net/en/", True),
             url_filter.HostRule("example.com/de/", False), url_filter.HostRule("org/fr/", True))
TOKENIZER = "byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op2_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_tagger.find_private(read(spark, sf_dir, "documents"))
    return spans.mapInArrow(pii_tagger.digest, pii_tagger.DIGEST)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), suffix_dedup.digest, suffix_dedup.DIGEST)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), line_dedup.digest, line_dedup.DIGEST)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != line_dedup.NO_ID, F.col("doc_id")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash_dedup.near_groups(read(spark, sf_dir, "documents"), n=2)
    known = lambda c: F.when(F.col(c) != minhash_dedup.NO_ID, F.col(c))
    return groups.select(known("_id").alias("doc_id"), "n_shingles", known("component").alias("component_id"),
                         (F.col("_id") == F.col("component")).alias("kept"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_binary.new_folder(spark, "tokens")
    token_binary.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_binary.read_documents(spark, path, token_binary.crc32_ids, "ids_crc32 bigint")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.graded(read(spark, sf_dir, "documents"))
    return spans.mapInArrow(secret_scan.digest, secret_scan.DIGEST)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.verdict(quality_rules.BASE)).alias("base_failed"),
                       quality_rules.verdict(quality_rules.STRICT).alias("kept"), "fail_bits")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance_resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select(F.col("_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_relative_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_parse.remove_passages(read(spark, sf_dir, "documents"), relative_parse.digest, relative_parse.DIGEST)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pii_tagger": op2_pii_tagger,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_binary": op8_token_binary,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resample": op11_importance_resample,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_relative_parse": op13_relative_parse,
}
