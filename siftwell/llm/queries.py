"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import embedding_dedup, exact_dedup, language_model, line_dedup, mixing, packing, pii, quality, simhash_dedup, toxicity
from siftwell.llm.common import read_table


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("row_id")


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.siftwell.pseudonym.key", pii.DEMONSTRATION)
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), key)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack_sequences, op2_hmm_scores, op3_toxicity, op4_simhash_near_dedup, op5_mix_sources, op6_embedding_near_dedup, op7_pseudonyms, op8_exact_dedup, op9_line_dedup, op10_quality)
}

#: The white space that SQL deletes before texts are compared.
ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        with t as (
            select doc_id, length(coalesce(text, '')) as n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
            from documents
        ), g as (
            select text_sha256, count(*) as group_size,
                   first(doc_id order by n_points desc, doc_id nulls first) as keep_id
            from t group by text_sha256
        )
        select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, t.text_sha256
        from t join g using (text_sha256)
    """,
}
