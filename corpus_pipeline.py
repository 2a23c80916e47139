"""The corpus pipeline: STAGES over ``documents``, each on all that the one before kept.

Quality, exact copies, near copies, packing. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrasieve.llm import bpe, common, exact_dedup, ngram_join, packing, quality


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in windows of 1024 tokens."""
    return packing.pack(docs, bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", reject_bad), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("packing", pack)]
# Neither the learnt rules nor the components of the n-gram join can be stated in SQL;
# tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and what it wrote besides is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.keep(common.cut(stage(spark, docs, sf_dir)))
        if last:
            common.drop_cut(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
