"""The training-corpus pipeline over the documents table.

Toxic documents go, then those that the quality rules reject, then exact and
near duplicates but one of each group; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costmart.llm import exact_dedup, fertility, minhash, packing, toxicity
from costmart.llm.common import keep_table, table
from costmart.llm.queries import vocabulary

CAPACITY = 2048


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands accept."""
    return fertility.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of equal texts (A-Z lower-cased): the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group linked by five-word shingles at 0.8: the smallest id."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of ``CAPACITY`` tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", civil),
    ("quality rules", good),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("packing", packed),
]

#: The scores, signatures and token ids of the stages are beyond SQL; the tests
#: compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each reading the Parquet table that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep_table(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
