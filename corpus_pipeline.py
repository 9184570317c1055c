"""A training corpus from ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared folder and read again as the next stage's ``docs``; so
a lost executor never costs more than the stage at work. All but the last
return the columns of ``documents``.

1. quality_rules: rows that fail the policy ``v1`` go.
2. near_dedup: of each group of near copies (5-word shingles, Jaccard of at
   least 0.8) the smallest id stays.
3. decontaminate: documents that hold a passage of ``benchmark`` go.
4. source_mix: texts are cut to the words that the mix takes; words taken
   twice come in a second row of the document.
5. token_binary: ids in directly addressable codes, read back per row.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from allelix.llm import decontaminate, minhash_dedup, quality_rules, source_mix, token_binary
from allelix.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_copies(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = token_binary.new_folder(spark, "pipeline-tokens")
    token_binary.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return token_binary.read_documents(spark, path, token_binary.crc32_ids, "ids_crc32 bigint")


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("source_mix", mixed),
    ("token_binary", token_files),
]

# tokenization and the seeded mix are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
