"""Corpus pipeline: quality classifier, exact dedup, near-duplicates, mixing, packing. Counted as part of snapwarden.llm.

Rows are told apart by numbers that a stage draws once, never by doc_id: ids may be null or repeated. A document's columns
travel in a struct, so extra columns may have any name. Null texts count as empty. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from snapwarden.llm.exact_dedup import distinct_documents
from snapwarden.llm.mixing import mixed_documents
from snapwarden.llm.packing import pack
from snapwarden.llm.quality import kept_documents
from snapwarden.llm.simhash import near_duplicates
from snapwarden.llm.storage import kept_until, materialise, numbered, release

_earlier: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage: what it returns must be written before the next stage is called, which removes this one's scratch tables."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with kept_until(spark, _earlier):
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, each row judged by itself; null, empty and blank texts go."""
    return kept_documents(docs)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z in lower case), the first of the table; a row given twice comes out once."""
    return distinct_documents(docs, numbered(docs, "exact-rows"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more), the first of the table."""
    return near_duplicates(docs, numbered(docs, "near-rows"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in shuffled order; documents drawn twice are there twice, a null source is a source, documents without words go."""
    return mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, sources in the proportions of the mix; every row is packed as often as it comes."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to weights", mixed), ("packing", packed)]

#: The classifier's training and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        given, docs = docs, materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(given)
    return STAGES[-1][1](spark, docs, sf_dir)
