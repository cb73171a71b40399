"""A training-corpus pipeline over `documents`: every stage reads what the stage before it kept, as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talus.llm import bpe, language, mixing, near_copies, toxicity
from talus.llm.common import table
from talus.llm.queries import TOKENIZER
from talus.runtime import remove, work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labels of the same folder."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for no language go, and those without a letter."""
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: texts are linked by op8's SimHash fingerprints (two or fewer differing bits)
    and by a Jaccard similarity of their five-word shingles of 0.8 or more."""
    return near_copies.keep_one(docs, fingerprints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document may come twice or not at all."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Trained models and seeded permutations are beyond SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the stored input of a stage is removed once its output is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
