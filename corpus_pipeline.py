"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns the columns of documents, but for the last, which returns packed pieces. run()
writes what a stage returns to the shared folder and reads it as the next one's docs.

Texts are read whole, however long. An empty table gives no rows at every stage. Extra
columns, whatever their names, go through all stages but the last as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, ngram_join, packing, quality, secrets
from quarry.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust estimate keep.

    Null, empty and short texts go. Null languages and sources are groups of their own, ids
    play no part. Repeated rows share one verdict, as do ties in distance.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id.

    Null and empty texts are linked with nothing, and stay. A row without an id stays. Of
    rows with the same id and text one stays.
    """
    return ngram_join.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars of changed texts is counted anew.

    Null and empty texts stay as they are. Repeated rows are changed alike; where spans
    overlap or tie, one mark stands for all of them.
    """
    return secrets.redact(docs, count_col="n_chars")


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of training.

    Null and empty texts have no words, so none of them is taken. Null sources are one source,
    the last. Rows of one id keep a fixed order by size and text; ties in position go by id.
    """
    return mixing.curriculum(docs, position_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is the end id alone; a null id stays null. Repeated rows are packed
    as often as they stand. Pieces of equal length are placed in the order of doc_id.
    """
    return packing.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("curriculum mix", curriculum_mix),
    ("packing", pack_sequences),
]

#: Robust estimates, components and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
