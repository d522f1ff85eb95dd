"""The training-data pipeline: each stage's rows are written as Parquet and read as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import mixing, quality, sharding, similar, suffixes
from tally.llm.common import shared_folder

#: SQL can't express the near-duplicate and mixing stages; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are boilerplate in their source.

    Null and empty texts are rejected; repeated rows stay or go together; an empty table gives no rows.
    """
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are pairs whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints compared bit-sliced choose the pairs whose sets are compared. All null texts and texts without words
    are one component, repeated rows leave one; an empty table gives no rows.
    """
    return similar.drop_similar(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null and empty texts and repeated rows stay, an empty table gives no rows."""
    return suffixes.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words stays once, null sources are one source, an empty table gives no rows."""
    return mixing.mixed_documents(docs)


def sharding_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document of the mix; repeat numbers equal rows, a null text has 0 bytes, an empty table gives no rows."""
    return sharding.shards(docs).drop("text_hash")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{number}")
        docs = spark.read.parquet(path)
