"""A training corpus out of ``documents``: five stages, each written and read again by the next.

``STAGES`` lists them as (name, function); a function takes (spark, docs, folder)
and returns a DataFrame. All but the last return the columns of documents.
``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.bagminhash import one_of_each
from tabularium.llm.packing import pack_documents
from tabularium.llm.simhash import contaminated
from tabularium.llm.registry import read, row_key
from tabularium.llm.suffix_trees import with_unique_words
from tabularium.llm.toxicity import fitted, without_toxic
from tabularium.session import shared_path


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below 0.5; the examples are those of the given documents that have a label."""
    return without_toxic(docs, fitted(spark, docs, read(spark, folder, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without words of passages that stand in several places."""
    return with_unique_words(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = row_key(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    found = contaminated(docs, read(spark, folder, "benchmark")).select("key").distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(found, "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Signatures, suffix trees and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
