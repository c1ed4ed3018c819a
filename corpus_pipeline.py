"""Corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
``documents``; what a stage rejects is gone for the later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.llm import bpe, ngramjoin, quality, raking, toxicity
from gridlake.llm.queries import MIX, table, tokenizer
from gridlake.session import staging_path

# Near duplicates of the pipeline: word 5-grams, Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, "4/5"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the boosted trees."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies."""
    return ngramjoin.keep_one(docs, SHINGLE, SIMILARITY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that bring source, language and topic to their targets."""
    return raking.mix(docs, **MIX).filter("sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    return bpe.round_trip(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("encode", encode),
]

# Learned models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name.replace(' ', '-')}")
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
