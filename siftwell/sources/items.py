"""The source contract: every source gives rows of one shape, and sources are registered by name.

``uri, title, content, hash, source_type, metadata`` where metadata maps strings to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import SourceError

ITEM = "uri string, title string, content string, hash string, source_type string, metadata map<string,string>"

Loader = Callable[[SparkSession, dict], DataFrame]


def item_columns(uri: Column, title: Column, content: Column, source_type: str, metadata: Column | None = None) -> list[Column]:
    meta = metadata if metadata is not None else F.expr("cast(map() as map<string,string>)")
    return [uri.alias("uri"), title.alias("title"), content.alias("content"), F.sha2(content, 256).alias("hash"), F.lit(source_type).alias("source_type"), meta.alias("metadata")]


class Registry:
    """Loaders by name; ``list_items`` reads a source, ``fetch_item`` one of its items by uri."""

    def __init__(self):
        self.loaders: dict[str, Loader] = {}

    def register(self, name: str, loader: Loader) -> None:
        self.loaders[name] = loader

    def get(self, name: str) -> Loader:
        if name not in self.loaders:
            raise SourceError(f"no source {name!r}; there are {sorted(self.loaders)}")
        return self.loaders[name]

    def list_items(self, spark: SparkSession, name: str, options: dict) -> DataFrame:
        return self.get(name)(spark, options)

    def fetch_item(self, spark: SparkSession, name: str, options: dict, uri: str) -> DataFrame:
        return self.list_items(spark, name, options).where(F.col("uri") == uri)

    @classmethod
    def with_defaults(cls) -> "Registry":
        from siftwell.sources import files, pages, tabular

        out = cls()
        out.register("file", files.load_files)
        out.register("csv", tabular.load_csv)
        out.register("json", tabular.load_json)
        out.register("sql", tabular.load_sql)
        out.register("url", pages.load_url_table)
        out.register("github", pages.load_repository_files)
        out.register("pdf", files.load_pdf)
        return out
