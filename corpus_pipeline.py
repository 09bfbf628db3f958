"""A corpus pipeline: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and returns what it keeps
with these columns; the last adds epoch (from 0) and taken (words of this copy), a row per copy of a document.
Each stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepath.llm.common import stage, table
from tidepath.llm.decontam import drop_contaminated
from tidepath.llm.exact import drop_exact_copies
from tidepath.llm.langid import keep_identified
from tidepath.llm.mixing import mixed
from tidepath.llm.neardup import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts that are null or have no letters go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by similar shingle sets."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: copies of documents, epoch by epoch, whose words meet each source's target."""
    return mixed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The language model, the links between near copies and the alignments are beyond SQL; tests/llm goes through all stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
