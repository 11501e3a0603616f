"""Roll-ups: directories, counts of an index, providers, languages, search statistics, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X

MOST_CONCEPTS = 20


def mode(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The commonest non-null value of each group, the smallest of equals, counted before it is picked."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), value)).alias(name))


def directories(documents: DataFrame) -> DataFrame:
    """One row for each folder of a collection that holds active documents.

    ``path, collection, depth, file_count, child_dir_count, dominant_language, dominant_category,
    concepts``. Children are counted by their parent's name, which is an equality join.
    ``documents`` has collection, path, category and concepts (an array).
    """
    rows = documents.where("active").withColumn("dir", X.parent_dir(F.col("path"))).withColumn("ext", X.extension(F.col("path")))
    keys = ["collection", "dir"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("file_count"))
    named = rows.select(*keys, F.explode("concepts").alias("c")).distinct()
    w = Window.partitionBy(*keys).orderBy("c")
    listed = named.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MOST_CONCEPTS).groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("concepts"))
    children = sizes.where(F.col("dir").contains("/")).groupBy("collection", F.regexp_replace("dir", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("child_dir_count"))
    out = sizes.join(mode(rows, keys, "ext", "dominant_language"), keys, "left").join(mode(rows, keys, "category", "dominant_category"), keys, "left").join(listed, keys, "left").join(children, keys, "left")
    return out.select(
        F.concat("collection", F.lit("/"), "dir").alias("path"),
        "collection",
        (F.length("dir") - F.length(F.replace("dir", F.lit("/"), F.lit("")))).alias("depth"),
        "file_count",
        F.coalesce("child_dir_count", F.lit(0)).alias("child_dir_count"),
        "dominant_language",
        "dominant_category",
        F.coalesce("concepts", F.expr("cast(array() as array<string>)")).alias("concepts"),
    )


def list_directories(dirs: DataFrame, collection: str | None = None, parent: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Folders in order of path; ``max_depth`` counts from the collection's own folders at 0."""
    if collection is not None:
        dirs = dirs.where(F.col("collection") == collection)
    if parent is not None:
        dirs = dirs.where(F.col("path").startswith(parent))
    if max_depth is not None:
        dirs = dirs.where(F.col("depth") <= max_depth)
    return dirs.orderBy("path")


def index_stats(documents: DataFrame, content: DataFrame, collections: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row of counts: collections, documents, content, embedded and pending hashes."""
    docs = documents.agg(F.count_if("active").alias("documents"), F.count_if(~F.col("active")).alias("inactive"), F.countDistinct(F.when(F.col("active"), F.col("hash"))).alias("hashes"))
    done = documents.where("active").select("hash").distinct().join(embedded.select("hash").distinct(), "hash", "left_semi").agg(F.count("*").alias("embedded"))
    stats = docs.crossJoin(done).crossJoin(content.agg(F.count("*").alias("content"))).crossJoin(collections.agg(F.count("*").alias("collections")))
    return stats.select("collections", "documents", "inactive", "content", "embedded", (F.col("hashes") - F.col("embedded")).alias("pending"))


def provider_rollup(collections: DataFrame, documents: DataFrame) -> DataFrame:
    counted = collection_counts(collections, documents)
    return counted.groupBy("provider_type").agg(F.count("*").alias("collections"), F.sum("documents").alias("documents"))


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    per = documents.where("active").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"))
    return collections.join(per, "name", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def dominant_language(rows: DataFrame, language: str = "language", weight: str = "document_count") -> DataFrame:
    """One row: the language with the largest sum of weights, the first by name of equals."""
    return rows.groupBy(language).agg(F.sum(weight).alias("n")).agg(F.min_by(language, F.struct((-F.col("n")).alias("n"), language)).alias("language"))


def search_stats(log: DataFrame) -> DataFrame:
    """One row of a query log with kind, micros, cache_hit: counts, mean latency, hit rate."""
    return log.agg(
        F.count("*").alias("searches"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("bm25", "vector", "hybrid")],
        F.avg("micros").alias("mean_micros"),
        F.coalesce(F.count_if("cache_hit") / F.count("cache_hit"), F.lit(0.0)).alias("hit_rate"),
    )


def recall_at_k(results: DataFrame, expected: DataFrame, k: int, qid: str = "query_id", key: str = "id") -> DataFrame:
    """``qid, recall``: share of a query's expected rows among its first ``k`` (``rank`` from 0)."""
    top = results.where(F.col("rank") < k).select(qid, key).distinct()
    hits = expected.join(top.withColumn("hit", F.lit(1)), [qid, key], "left")
    return hits.groupBy(qid).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def glossary_totals(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """One row: concepts and their links to chunks."""
    return concepts.agg(F.count("*").alias("concepts")).crossJoin(links.agg(F.count("*").alias("links")))


def concepts_by_count(links: DataFrame) -> DataFrame:
    """``normalized, chunk_count`` with the most used concepts first."""
    return links.groupBy("normalized").agg(F.countDistinct("chunk_hash").alias("chunk_count")).orderBy(F.desc("chunk_count"), "normalized")


def api_metrics(calls: DataFrame) -> DataFrame:
    """One row of a log of calls (ok, cache_hit, millis): requests, errors, hits, misses, hit rate in percent, mean latency."""
    return calls.agg(
        F.count("*").alias("requests"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.count_if("cache_hit").alias("hits"),
        F.count_if(~F.col("cache_hit")).alias("misses"),
        F.coalesce(F.count_if("cache_hit") / F.count("*") * 100, F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.sum("millis") / F.count("*"), F.lit(0.0)).alias("mean_millis"),
    )
