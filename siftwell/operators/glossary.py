"""Concepts, their links to chunks, and glossary search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import bm25


def upsert_concepts(terms: DataFrame, order: str = "ord") -> DataFrame:
    """``normalized, term`` of each concept: the first spelling stays. ``terms`` has term and an order."""
    return terms.withColumn("normalized", X.normalised_term(F.col("term"))).groupBy("normalized").agg(F.min_by("term", order).alias("term"))


def link_concepts(concepts: DataFrame, extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every concept of a document with every chunk of it, once: ``normalized, chunk_hash, document_hash, snippet``.

    ``extracted`` has document_hash, term, snippet; ``chunks`` hash and document_hash.
    """
    own = extracted.withColumn("normalized", X.normalised_term(F.col("term"))).join(concepts.select("normalized"), "normalized", "left_semi")
    pairs = own.join(chunks.select(F.col("hash").alias("chunk_hash"), "document_hash"), "document_hash")
    return pairs.groupBy("normalized", "chunk_hash").agg(F.min("document_hash").alias("document_hash"), F.min_by("snippet", "document_hash").alias("snippet"))


def chunk_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("normalized").agg(F.countDistinct("chunk_hash").alias("chunk_count"))


def concepts_of(links: DataFrame, concepts: DataFrame, document_hash: str) -> DataFrame:
    return links.where(F.col("document_hash") == document_hash).join(concepts, "normalized").select("term").distinct().orderBy("term")


def orphan_concepts(concepts: DataFrame, links: DataFrame) -> DataFrame:
    return concepts.join(links.select("normalized").distinct(), "normalized", "left_anti")


def search_concepts(concepts: DataFrame, query: str, limit: int) -> DataFrame:
    """Concepts that hold all words of the query in term or normalised form, best relevance first."""
    found = bm25.search(concepts, query, {"term": 1.0, "normalized": 1.0}, "normalized")
    return found.orderBy(F.desc("relevance"), "normalized").limit(limit).join(concepts, "normalized")


def glossary_search(concepts: DataFrame, links: DataFrame, documents: DataFrame, query: str, limit: int, min_confidence: float = 0.8, concept_limit: int = 10) -> DataFrame:
    """Documents of the concepts that match, each once, at a constant score."""
    found = search_concepts(concepts, query, concept_limit).select("normalized", "relevance")
    hits = links.join(F.broadcast(found), "normalized").groupBy("document_hash").agg(F.max("relevance").alias("relevance"))
    rows = documents.where("active").join(hits, F.col("hash") == F.col("document_hash")).groupBy("hash").agg(F.min("id").alias("id"), F.max("relevance").alias("relevance"))
    return rows.withColumn("score", F.lit(float(min_confidence))).orderBy(F.desc("relevance"), "id").limit(limit).select("id", "hash", "score")
