"""The corpus pipeline: toxicity filter, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``; the last
returns one row for each packed piece. Each row is a document of its own to the deduplication stages,
also where doc_id is null or repeats: they number the rows they read and keep one row of each group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from siftwell.llm.common import free_name, read_table, staged

TOXIC_FROM = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``; the model is learned from the labelled ones."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "__toxicity")
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, row_id = exact_dedup.numbered(docs)
    return exact_dedup.keep_rows(rows, row_id, exact_dedup.first_rows(rows, row_id))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that SimHash links."""
    rows, row_id = exact_dedup.numbered(docs)
    return exact_dedup.keep_rows(rows, row_id, simhash_dedup.first_rows(rows, row_id))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of the packed sequences."""
    return packing.pack(docs).drop("row_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned and sampled stages; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
