"""Web pages and repository files that were fetched before: tables of url and body.

The engine itself never goes to the network: a fetcher writes ``url, html`` (or ``repo, path, content``)
tables, which these sources read like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.sources.items import item_columns

REPOSITORY = r"^https?://github\.com/([^/]+)/([^/#?]+?)(?:\.git)?(?:/(blob|tree)/([^/]+)/(.*))?/?$"


def load_pages(pages: DataFrame) -> DataFrame:
    """``id`` and the item columns of a table with page_id, url, html."""
    return pages.select(F.col("page_id").alias("id"), *item_columns(F.col("url"), X.page_title(F.col("url"), F.col("html")), F.col("html"), "url"))


def load_url_table(spark: SparkSession, options: dict) -> DataFrame:
    rows = spark.read.parquet(options["path"]) if "path" in options else spark.table(options["table"])
    return rows.select(*item_columns(F.col("url"), X.page_title(F.col("url"), F.col("html")), F.col("html"), "url"))


def repository_parts(url: Column) -> Column:
    """A struct owner, repo, kind, ref, path of a repository address; empty parts where it has none."""
    return F.struct(*[F.regexp_extract(url, REPOSITORY, i + 1).alias(n) for i, n in enumerate(("owner", "repo", "kind", "ref", "path"))])


def load_repository_files(spark: SparkSession, options: dict) -> DataFrame:
    """Items of a fetched table ``repo, path, content``; options path or table, pattern."""
    rows = spark.read.parquet(options["path"]) if "path" in options else spark.table(options["table"])
    rows = rows.where(F.col("path").rlike(X.glob_regex(options.get("pattern", "**/*.md"))))
    uri = F.concat(F.lit("https://github.com/"), "repo", F.lit("/blob/HEAD/"), "path")
    return rows.select(*item_columns(uri, X.heading_title(F.col("content"), F.col("path")), F.col("content"), "github", F.create_map(F.lit("repo"), F.col("repo"), F.lit("path"), F.col("path"))))
