"""From raw documents to token ids: four stages, each over all that the one before kept.

language_id   drops documents that the language models reject (without letters, or far from every learned language)
near_dedup    keeps one document of each near-duplicate class
mix           samples documents so that tokens meet target weights by source, language and topic
encode        encodes each document to token ids, decodes them again and returns the ids and digests of both

Every stage is handed over as Parquet in the shared folder, so each starts from files and survives lost executors.

Defined cases: a null or empty text, or one without letters, goes in the first stage; rows that repeat a text stay
once, whatever their ids, null ones too; null categories are categories of their own in the mix; very long texts are
worked on whole; extra columns are kept by all stages but the last; an empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, language_id, mixing, near_dup
from millrace.llm.common import dropped, scratch, small_batches, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; the models are learned from the labelled ones among them."""
    small_batches(spark)
    return language_id.accepted(docs, language_id.learn(docs.where(language_id.learnable())))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, mixing.TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the language models, nor the sketches, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            dropped(spark, last)
        last = docs
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
