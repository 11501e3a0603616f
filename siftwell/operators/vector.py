"""Cosine search over vectors, exact and by locality-sensitive hashing, with the document boosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The boosts of document search.
COLLECTION_BOOSTS = {"docs": 1.5}
SOURCE_SUFFIX, SOURCE_BOOST = "-src", 0.7
TEST_BOOST, PATH_BOOST, TITLE_BOOST = 0.1, 10.0, 4.0
OVERFETCH = 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for lengths that differ, empty vectors and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarities(vectors: DataFrame, query: Sequence[float] | DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``. The query is a list, or a DataFrame of one row, column ``q``."""
    if isinstance(query, DataFrame):
        return vectors.crossJoin(F.broadcast(query.limit(1).select("q"))).withColumn("score", cosine(F.col(embedding), F.col("q"))).drop("q")
    return vectors.withColumn("score", cosine(F.col(embedding), F.array(*map(lambda x: F.lit(float(x)), query))))


def top_k(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def query_words(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\s?!]", query.lower()) if len(w.encode()) >= 2]


def boosted(score: Column, importance: Column, collection: Column, path: Column, title: Column, query: str, collections: Mapping[str, float] = COLLECTION_BOOSTS) -> Column:
    """A score after the boosts: importance, collection, tests, and the query's words in path or title."""
    by_name = F.lit(1.0)
    for name, factor in collections.items():
        by_name = F.when(collection == name, factor).otherwise(by_name)
    by_name = F.when(collection.isin(*collections), by_name).when(collection.contains(SOURCE_SUFFIX), SOURCE_BOOST).otherwise(F.lit(1.0)) if collections else by_name
    tests = F.when(path.contains("/tests/") | path.contains("/test/"), TEST_BOOST).otherwise(F.lit(1.0))
    words = F.array(*map(F.lit, query_words(query))) if query_words(query) else F.expr("cast(array() as array<string>)")
    lower_path, lower_title = F.lower(path), F.lower(F.coalesce(title, F.lit("")))
    step = lambda a, w: F.when(a["stop"], a).when(F.contains(lower_path, w), F.struct((a["f"] * PATH_BOOST).alias("f"), F.lit(True).alias("stop"))).when(
        F.contains(lower_title, w), F.struct((a["f"] * TITLE_BOOST).alias("f"), F.lit(False).alias("stop"))
    ).otherwise(a)
    by_words = F.aggregate(words, F.struct(F.lit(1.0).alias("f"), F.lit(False).alias("stop")), step, lambda a: a["f"])
    return score * importance * by_name * tests * by_words


def best_per_document(scored: DataFrame, key: str = "hash", *ties: str) -> DataFrame:
    """The best-scored row of each document."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    return scored.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def to_percent(scored: DataFrame) -> DataFrame:
    """Scores as percent of the best one; unchanged if that isn't positive. ``scored`` is a result page."""
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best") * 100).otherwise(F.col("score"))).drop("best")


def search_documents(vectors: DataFrame, documents: DataFrame, query_vector, query: str, limit: int, min_score: float = 0.0) -> DataFrame:
    """Vector search over documents: over-fetch, hydrate, boost, best per document, page, percent.

    ``vectors`` has hash, seq, embedding; ``documents`` id, hash, collection, path, title, importance.
    """
    near = similarities(vectors, query_vector).orderBy(F.desc("score"), "hash", "seq").limit(OVERFETCH * limit).select("hash", "seq", "score")
    first = Window.partitionBy("hash", "seq").orderBy("id")
    hydrated = F.broadcast(near).join(documents, "hash").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    scored = hydrated.withColumn("score", boosted(F.col("score"), F.coalesce("importance", F.lit(1.0)), F.col("collection"), F.col("path"), F.col("title"), query))
    page = best_per_document(scored, "hash", "seq").where(F.col("score") >= min_score).orderBy(F.desc("score"), "hash").limit(limit)
    return to_percent(page)


def search_chunks(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query_vector, limit: int, min_score: float = 0.0) -> DataFrame:
    """Vector search over chunks by raw cosine, without boosts: the first ``limit`` vectors, of them those of at
    least ``min_score``, each with its chunk and the first active document that has it.

    ``vectors`` has chunk_hash, embedding; ``chunks`` hash, document_hash and more; ``documents`` id, hash and more.
    """
    near = similarities(vectors, query_vector).orderBy(F.desc("score"), "chunk_hash").limit(limit).select("chunk_hash", "score").where(F.col("score") >= min_score)
    own = F.broadcast(near).join(chunks.withColumnRenamed("hash", "chunk_hash"), "chunk_hash")
    hydrated = own.join(documents.withColumnRenamed("hash", "document_hash"), "document_hash")
    w = Window.partitionBy("chunk_hash").orderBy("id")
    return hydrated.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth").orderBy(F.desc("score"), "chunk_hash")


class LshIndex:
    """Approximate nearest neighbours by random projections on normalised vectors; exact below ``exact_below`` rows."""

    def __init__(self, vectors: DataFrame, bucket: float = 0.5, tables: int = 8, exact_below: int = 1000, seed: int = 1):
        from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
        from pyspark.ml.functions import array_to_vector

        self.vectors = vectors
        self.exact = vectors.limit(exact_below).count() < exact_below
        raw = vectors.select("*", array_to_vector(F.col("embedding")).alias("raw"))
        self.rows = Normalizer(inputCol="raw", outputCol="unit").transform(raw).drop("raw")
        self.model = None if self.exact else BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(self.rows)

    def nearest(self, query: Sequence[float], k: int) -> DataFrame:
        """``id, score`` by cosine, best first."""
        if self.exact:
            return top_k(similarities(self.vectors, query), k).select("id", "score")
        from pyspark.ml.linalg import Vectors

        norm = sum(x * x for x in query) ** 0.5
        found = self.model.approxNearestNeighbors(self.rows, Vectors.dense([x / norm for x in query]), 4 * k)
        return top_k(similarities(found.select("id", "embedding"), query), k).select("id", "score")
