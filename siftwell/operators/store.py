"""Tables as Parquet folders with the maintenance of an index: ingest by difference, upserts, collection of garbage.

Every write goes to a new version folder and is made current by putting its name in place of the old one in
a single rename, so readers see whole versions only and a failed write changes nothing. Appends add files
to the current version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.errors import NotFound
from siftwell.schemas import TABLES, schema


class Store:
    """Named tables under one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.path}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.path}/{name}/CURRENT").first()[0]

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            if name not in TABLES:
                raise NotFound(name)
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}/{version}")

    def write(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        version = uuid.uuid4().hex
        writer = rows.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}/{version}")
        self._point(name, version)
        return self.read(name)

    def append(self, name: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Add rows to a table without rewriting it; they are seen when all are there."""
        version = self._current(name)
        if version is None:
            return self.write(name, rows, partition_by)
        writer = rows.write.mode("append")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}/{version}")
        return self.read(name)

    def _point(self, name: str, version: str) -> None:
        """Make a version current by one rename over the old name: there is never none."""
        fs, p = self._fs(f"{self.path}/{name}/CURRENT.{version}")
        out = fs.create(p, True)
        out.write(bytearray(version + "\n", "utf-8"))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        overwrite = getattr(hadoop, "Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = overwrite
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(p), fs.makeQualified(self._fs(f"{self.path}/{name}/CURRENT")[1]), options)

    def vacuum(self, name: str) -> None:
        """Delete all versions of a table but the current one."""
        version = self._current(name)
        fs, p = self._fs(f"{self.path}/{name}")
        for status in fs.listStatus(p):
            last = status.getPath().getName()
            if last not in (version, "CURRENT"):
                fs.delete(status.getPath(), True)


# -- content-addressed ingest -----------------------------------------------------------------------


def new_content(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (hash, doc) whose hash is not stored yet, once each."""
    return incoming.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def diff(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("collection", "path"), deletions: bool = True) -> DataFrame:
    """``keys, old_hash, new_hash, action``: insert, update, skip, reactivate and, for what is gone, delete.

    ``current`` has the keys, hash and active; ``incoming`` the keys and hash. One full outer join.
    """
    old = current.select(*keys, F.col("hash").alias("old_hash"), F.col("active").alias("was_active"))
    new = incoming.select(*keys, F.col("hash").alias("new_hash"))
    both = old.join(new, list(keys), "full_outer")
    gone = F.when(F.col("was_active"), "delete").otherwise("skip") if deletions else F.lit("skip")
    action = (
        F.when(F.col("old_hash").isNull(), "insert")
        .when(F.col("new_hash").isNull(), gone)
        .when(~F.col("was_active"), "reactivate")
        .when(F.col("old_hash") != F.col("new_hash"), "update")
        .otherwise("skip")
    )
    return both.select(*keys, "old_hash", "new_hash", action.alias("action"))


def apply_diff(current: DataFrame, incoming: DataFrame, changes: DataFrame, keys: Sequence[str] = ("collection", "path")) -> DataFrame:
    """The document table after :func:`diff`'s changes; columns as in ``incoming`` plus ``active``."""
    acts = changes.select(*keys, "action")
    taken = incoming.join(acts.where(F.col("action").isin("insert", "update", "reactivate")), list(keys)).drop("action").withColumn("active", F.lit(True))
    rest = current.join(acts.where(F.col("action").isin("skip", "delete")), list(keys)).withColumn("active", F.when(F.col("action") == "delete", False).otherwise(F.col("active"))).drop("action")
    return taken.unionByName(rest, allowMissingColumns=True)


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace stored rows of the same keys."""
    return stored.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def update_columns(stored: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored rows with ``columns`` taken from ``changes`` where it has the key and a value."""
    fresh = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(fresh, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def soft_delete(documents: DataFrame, condition) -> DataFrame:
    return documents.withColumn("active", F.col("active") & ~F.coalesce(condition, F.lit(False)))


def hard_delete(documents: DataFrame) -> DataFrame:
    return documents.where("active")


def live_only(rows: DataFrame, live: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose key is live: the rest is garbage."""
    return rows.join(live.select(key).distinct(), key, "left_semi")


def orphans(rows: DataFrame, live: DataFrame, key: str = "hash") -> DataFrame:
    return rows.join(live.select(key).distinct(), key, "left_anti")


def needs_embedding(documents: DataFrame, embedded: DataFrame) -> DataFrame:
    """``hash, path`` of active content that has no vector yet; the smallest path where several share a hash."""
    return documents.where("active").join(embedded.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))


def cache_split(requests: DataFrame, cache: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, misses) of requests against a cache table."""
    joined = requests.join(cache.select(*keys, value), list(keys), "left")
    return joined.where(F.col(value).isNotNull()), joined.where(F.col(value).isNull()).drop(value)


def chunk_upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("document_hash", "seq")) -> DataFrame:
    """Chunks of re-chunked documents replace those documents' old ones; the last of repeated keys stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc("hash"))
    fresh = incoming.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return stored.join(incoming.select("document_hash").distinct(), "document_hash", "left_anti").unionByName(fresh, allowMissingColumns=True)


def label_table(chunks: DataFrame) -> DataFrame:
    """``chunk_hash, key, value`` of chunks' label maps."""
    return chunks.select(F.col("hash").alias("chunk_hash"), F.explode("labels"))


def remove_collection(documents: DataFrame, name: str) -> DataFrame:
    return soft_delete(documents, F.col("collection") == name)


def rename_collection(rows: DataFrame, old: str, new: str, column: str = "collection") -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def register_model(models: DataFrame, model: str, dimensions: int) -> DataFrame:
    row = models.sparkSession.createDataFrame([(model, dimensions)], "model string, dimensions int").withColumn("last_used_at", F.current_timestamp())
    return upsert(models, row, ["model"])


def incompatible_models(models: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Registered rows of a model with another number of dimensions."""
    return models.where((F.col("model") == model) & (F.col("dimensions") != dimensions))


def count_cached(cache: DataFrame, model: str) -> DataFrame:
    """One row: how many cached vectors a model has."""
    return cache.where(F.col("model") == model).agg(F.count("*").alias("cached"))


def count_by_model(vectors: DataFrame) -> DataFrame:
    """``model, n`` of stored vectors."""
    return vectors.groupBy("model").agg(F.count("*").alias("n"))


def embed_stats(requests: DataFrame) -> DataFrame:
    """One row of chunks to embed (hash, cached): documents, chunks, cached and computed ones, hit rate in percent."""
    return requests.agg(
        F.countDistinct("hash").alias("documents"),
        F.count("*").alias("chunks"),
        F.count_if("cached").alias("cached_chunks"),
        F.count_if(~F.col("cached")).alias("computed_chunks"),
        F.coalesce(F.count_if("cached") / F.count("*") * 100, F.lit(0.0)).alias("hit_rate"),
    )


def with_columns_of(rows: DataFrame, wanted: str, defaults: dict | None = None) -> DataFrame:
    """A stored table brought to the columns of a table in :mod:`siftwell.schemas`: what it lacks is added with its
    default or null, what it has beyond stays."""
    for field in schema(wanted).fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit((defaults or {}).get(field.name)).cast(field.dataType))
    return rows
