"""Contexts (descriptions of path prefixes), lookups and listings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X


def _matches(paths: DataFrame, contexts: DataFrame, path: str) -> DataFrame:
    """Each path with every context whose prefix it has.

    Prefixes of a path are as many as it has characters, so they are made as rows and joined by
    equality on the lengths that occur: no pair of path and context is formed that doesn't match.
    """
    sizes = contexts.agg(F.sort_array(F.collect_set(F.length("path"))).alias("__sizes"))
    own = paths.crossJoin(F.broadcast(sizes)).withColumn("__size", F.explode("__sizes")).where(F.length(path) >= F.col("__size"))
    own = own.withColumn("__prefix", F.expr(f"substring(`{path}`, 1, __size)"))
    right = contexts.select(F.col("path").alias("__prefix"), "context")
    return own.join(right, "__prefix").drop("__sizes")


def longest_prefix(paths: DataFrame, contexts: DataFrame, path: str = "path") -> DataFrame:
    """``path, context`` of the longest prefix; null where none matches."""
    found = _matches(paths.select(path).distinct(), contexts, path).groupBy(path).agg(F.max_by("context", "__size").alias("context"))
    return paths.join(found, path, "left")


def inherited(paths: DataFrame, contexts: DataFrame, path: str = "path", global_context: str | None = None) -> DataFrame:
    """``path, context``: the global context and all matching ones, shortest prefix first, by blank lines."""
    found = _matches(paths.select(path).distinct(), contexts, path).groupBy(path).agg(F.sort_array(F.collect_list(F.struct("__size", "context"))).alias("own"))
    parts = F.transform(F.coalesce("own", F.expr("cast(array() as array<struct<__size:int,context:string>>)")), lambda x: x["context"])
    if global_context is not None:
        parts = F.concat(F.array(F.lit(global_context)), parts)
    joined = paths.join(found, path, "left").withColumn("context", F.array_join(parts, "\n\n")).drop("own")
    return joined.withColumn("context", F.nullif("context", F.lit("")))


def missing_context(collections: DataFrame, contexts: DataFrame, name: str = "name") -> DataFrame:
    """Collections without a context of their own, unless there is one for everything (path ``/``)."""
    everything = contexts.where("path = '/'").limit(1).select(F.lit(1).alias("__all"))
    return collections.join(contexts.select(F.col("path").alias(name)), name, "left_anti").join(everything, F.lit(True), "left_anti")


# -- lookups ----------------------------------------------------------------------------------------


def by_path(documents: DataFrame, collection: str, path: str) -> DataFrame:
    return documents.where((F.col("collection") == collection) & (F.col("path") == path) & F.col("active"))


def by_docid(documents: DataFrame, docid: str) -> DataFrame:
    return documents.where(F.col("hash").startswith(docid.lstrip("#")) & F.col("active")).orderBy("id").limit(1)


def fuzzy(documents: DataFrame, text: str, limit: int) -> DataFrame:
    """Documents whose path or title holds ``text``, ignoring case; shortest path first."""
    low = text.lower()
    found = documents.where(F.col("active") & (F.contains(F.lower("path"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low))))
    return found.orderBy(F.length("path"), "id").limit(limit)


def lookup(documents: DataFrame, reference: str, limit: int = 1) -> DataFrame:
    """The first way that finds anything: docid, virtual path, ``collection/path``, fuzzy.

    One plan: each way's rows carry its number, and the smallest number that occurs stays.
    """
    ref = reference.removeprefix(X.SCHEME)
    collection, _, path = ref.partition("/")
    docid = reference.lstrip("#").lower()
    hexlike = len(docid) >= 6 and all(c in "0123456789abcdef" for c in docid)
    low = reference.lower()
    way = (
        F.when(F.col("hash").startswith(docid) if hexlike else F.lit(False), 0)
        .when((F.col("collection") == collection) & (F.col("path") == path), 1)
        .when(F.col("path") == reference, 2)
        .when(F.contains(F.lower("path"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low)), 3)
    )
    found = documents.where("active").withColumn("way", way).where("way is not null")
    return found.orderBy("way", F.length("path"), "id").limit(limit)


def by_prefix(documents: DataFrame, prefix: str) -> DataFrame:
    """Active documents whose ``collection/path`` starts with ``prefix``, in order."""
    full = F.concat("collection", F.lit("/"), "path")
    return documents.where("active").withColumn("full_path", full).where(F.col("full_path").startswith(prefix)).orderBy("full_path")


def by_pattern(documents: DataFrame, patterns: str) -> DataFrame:
    """Active documents by comma-separated globs or docids over ``path`` and ``collection/path``."""
    cond = F.lit(False)
    depth, part, parts = 0, "", []
    for c in patterns + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    for p in filter(None, parts):
        rx = X.glob_regex(p)
        cond = cond | F.col("path").rlike(rx) | F.concat("collection", F.lit("/"), "path").rlike(rx)
        if p.startswith("#") or (len(p) == 6 and all(c in "0123456789abcdef" for c in p)):
            cond = cond | F.col("hash").startswith(p.lstrip("#"))
    return documents.where(F.col("active") & cond)


def line_slice(documents: DataFrame, first: int = 1, count: int | None = None, most_bytes: int | None = None, body: str = "body") -> DataFrame:
    """Documents with only some lines of their body, from line ``first``; larger bodies than ``most_bytes`` are skipped."""
    if most_bytes is not None:
        documents = documents.where(F.octet_length(body) <= most_bytes)
    lines = F.split(body, "\n")
    part = F.slice(lines, first, count) if count is not None else F.slice(lines, F.lit(first), F.greatest(F.size(lines) - first + 1, F.lit(0)))
    return documents.withColumn(body, F.array_join(part, "\n"))


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
