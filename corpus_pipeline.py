"""A training corpus in five stages: quality rules, exact dedup, near dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
works on all rows that its predecessor kept. All but the last return the columns
of documents; the last returns the places of all pieces in the packed sequences.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are
handled as the operators' docstrings say; extra columns are kept up to the last
stage. Of repeated rows, the dedup stages keep one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsight.llm import exact_dedup, mixing, near_dedup, packing, quality
from tabsight.llm.common import written
from tabsight.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the threshold table keep."""
    return quality.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.kept_rows(docs, exact_dedup.exact_duplicates(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return exact_dedup.kept_rows(docs, near_dedup.near_duplicates(docs, words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, byte_bpe, capacity=2048, end_id=0).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: Near dedup, mixing and packing have no SQL form; the tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
