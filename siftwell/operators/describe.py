"""Metadata of documents and chunks without a model: an offline generator, and answers of a model as JSON.

A generator maps rows to columns; a caller with a model brings its answers as a ``response`` column instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X

MOST_KEYWORDS, LEAST_LETTERS = 10, 4
FIELDS = "summary string, llm_title string, keywords array<string>, category string, intent string, concepts array<string>, difficulty string, queries array<string>"


def _keywords(text, most: int):
    """The most frequent words of a text, the first in the alphabet of equals."""
    words = F.filter(X.tokens(text), lambda w: F.length(w) >= LEAST_LETTERS)
    counted = F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda s: s["w"])


def describe_documents(documents: DataFrame, most_words: int = 400) -> DataFrame:
    """``hash`` and :data:`FIELDS` for documents with hash, path, title, body: the first sentence as summary, frequent
    words of the title and the first ``most_words`` words as keywords, and kinds by path and length."""
    body = F.coalesce("body", F.lit(""))
    start = F.array_join(F.slice(F.split(F.concat_ws(" ", "title", body), r"\s+"), 1, most_words), " ")
    keys = _keywords(start, MOST_KEYWORDS)
    category = F.when(F.lower("path").rlike(r"readme|guide|tutorial|intro"), "tutorial").when(F.lower("path").rlike(r"\.(md|txt|rst)$"), "documentation").when(F.lower("path").rlike(r"\.(toml|ya?ml|json|ini|cfg)$"), "config").otherwise("code")
    size = F.length(body)
    return documents.select(
        "hash",
        X.first_sentence(body).alias("summary"),
        F.col("title").alias("llm_title"),
        keys.alias("keywords"),
        category.alias("category"),
        F.concat(F.lit("Describes "), F.coalesce("title", F.lit("something"))).alias("intent"),
        F.slice(keys, 1, 5).alias("concepts"),
        F.when(size < 500, "beginner").when(size < 2000, "intermediate").otherwise("advanced").alias("difficulty"),
        F.transform(F.slice(keys, 1, 3), lambda w: F.concat(F.lit("what is "), w)).alias("queries"),
    ).dropDuplicates(["hash"])


def describe_chunks(chunks: DataFrame) -> DataFrame:
    """``hash, summary, purpose, concepts, labels`` of chunks with hash, content, chunk_type, breadcrumb, language."""
    keys = _keywords(F.coalesce("content", F.lit("")), 5)
    labels = F.map_filter(F.create_map(F.lit("type"), F.col("chunk_type"), F.lit("language"), F.col("language")), lambda k, v: v.isNotNull())
    purpose = F.concat_ws(" ", F.coalesce("chunk_type", F.lit("text")), "breadcrumb")
    return chunks.select("hash", X.first_sentence(F.coalesce("content", F.lit(""))).alias("summary"), purpose.alias("purpose"), keys.alias("concepts"), labels.alias("labels")).dropDuplicates(["hash"])


def parse_response(responses: DataFrame, key: str = "hash", response: str = "response", fields: str = FIELDS) -> DataFrame:
    """``key`` and the fields of a model's answer: the JSON object in its text; rows without one are left out."""
    body = F.regexp_extract(F.col(response), r"(?s)\{.*\}", 0)
    return responses.select(key, F.from_json(body, fields, {"mode": "PERMISSIVE"}).alias("m")).where("m is not null").select(key, "m.*").where(" or ".join(f"{f.split()[0]} is not null" for f in fields.split(", ")))
