"""Link graph of documents and their importance by in-degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
#: Base weights by kind of document, and the bonus of links.
BASE = {"readme": 2.0, "user_doc": 1.8, "meta_doc": 0.6, "code": 1.0}
LINK_BONUS, MOST_BONUS = 0.3, 2.0


def normalised_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` resolved."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def resolved(source_path: Column, target: Column) -> Column:
    """A link target relative to the folder of the document that holds it."""
    folder = F.when(source_path.contains("/"), F.regexp_replace(source_path, "/[^/]*$", "/")).otherwise(F.lit(""))
    return normalised_path(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)))


def links(documents: DataFrame) -> DataFrame:
    """``id, collection, path, target_path, link_type`` of documents with id, collection, path, body."""
    body = F.coalesce("body", F.lit(""))
    marked = F.transform(
        F.filter(F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), F.lit(2)), lambda t: ~t.rlike("^https?://|^#")),
        lambda t: F.struct(F.lit("markdown").alias("link_type"), F.regexp_replace(t, "#.*$", "").alias("target")),
    )
    modules = F.flatten(
        F.transform(
            F.regexp_extract_all(body, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"), F.lit(1)),
            lambda m: F.array(*[F.struct(F.lit("code").alias("link_type"), F.concat(m, F.lit(end)).alias("target")) for end in (".rs", "/mod.rs")]),
        )
    )
    imports = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import\b"), F.lit(1)),
        lambda m: F.struct(F.lit("code").alias("link_type"), F.concat(F.lit("/"), F.regexp_replace(m, r"\.", "/"), F.lit(".py")).alias("target")),
    )
    none = F.slice(marked, 1, 0)
    found = F.when(F.col("path").endswith(".md"), marked).when(F.col("path").endswith(".rs"), modules).when(F.col("path").endswith(".py"), imports).otherwise(none)
    return documents.select("id", "collection", "path", F.explode(found).alias("l")).select("id", "collection", "path", resolved(F.col("path"), F.col("l.target")).alias("target_path"), F.col("l.link_type").alias("link_type"))


def link_edges(found: DataFrame, documents: DataFrame) -> DataFrame:
    """``source_id, target_id, link_type``, each once; targets that are no document are dropped."""
    targets = documents.select(F.col("id").alias("target_id"), "collection", F.col("path").alias("target_path"))
    return found.join(targets, ["collection", "target_path"]).select(F.col("id").alias("source_id"), "target_id", "link_type").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_links"))


def document_kind(path: Column) -> Column:
    return (
        F.when(path.rlike("(^|/)README\\.md$"), "readme").when(path.startswith("docs/") & path.endswith(".md"), "user_doc").when(path.endswith(".md"), "meta_doc").otherwise("code")
    )


def importance(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, path, in_links, importance``: base by kind times one plus the bonus of links."""
    table = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    joined = documents.select("id", "path").join(in_degree(edges), "id", "left").withColumn("in_links", F.coalesce("in_links", F.lit(0)))
    return joined.withColumn("importance", table[document_kind(F.col("path"))] * (1 + F.least(F.lit(LINK_BONUS) * F.col("in_links"), F.lit(MOST_BONUS))))
