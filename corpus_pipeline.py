"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Stages give null, empty and very long texts, ties, repeated rows, empty tables and extra columns, whatever their names, the
results that their operators' docstrings state; each says below what that means for the rows. All stages but the last
return the columns of their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import host_rules, mixing, near_dup, packing, surrogates
from halyard.llm.common import scratch
from halyard.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or their host's verdict rejects go: null and empty texts have no words and go; equal rows go
    or stay together."""
    return host_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked by similarities of 0.8 and more, stays: the one with the smallest
    doc_id, ties by a hash. Texts without words are linked to nothing and stay; rows without doc_id are told apart by text."""
    return near_dup.deduplicated(docs, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates, under the secret key of the session's setting ``KEY``; the published one, which
    protects nothing, only where that is unset, as in tests. Rows stay, null texts as null."""
    return surrogates.replaced(docs, key=spark.conf.get(KEY, surrogates.DEMO_KEY), count=None)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: never without words, at most three times. Equal rows are drawn each."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence: null and empty texts one piece of the end token, long
    ones several."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


#: The Spark setting that has the surrogates' key.
KEY = "spark.halyard.surrogates.key"

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("best_fit_packing", pack),
]

#: Hash-drawn mixing, surrogates and a tokenizer have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{place}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
