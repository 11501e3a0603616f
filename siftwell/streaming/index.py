"""Incremental maintenance: ingest by difference and postings of changed documents, by micro-batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import bm25, store


def upsert_postings(tables: store.Store, changed: DataFrame, weights: Mapping[str, float], key: str = "id") -> None:
    """Replace the postings and lengths of changed documents; an inactive document only loses its own."""
    ids = changed.select(key).distinct()
    live = changed.where("active") if "active" in changed.columns else changed
    for name, fresh in (("postings", bm25.postings(live, weights, key)), ("lengths", bm25.lengths(live, weights, key))):
        old = tables.read(name).join(ids, key, "left_anti") if tables.exists(name) else None
        tables.write(name, fresh if old is None else old.unionByName(fresh))


def ingest_batch(tables: store.Store, incoming: DataFrame) -> None:
    """Insert, update or reactivate the documents of a micro-batch by comparing content hashes."""
    last = incoming.groupBy("collection", "path").agg(F.max_by(F.struct("*"), "modified_at").alias("r")).select("r.*")
    if not tables.exists("documents"):
        tables.write("documents", last.withColumn("active", F.lit(True)))
        return
    current = tables.read("documents")
    changes = store.diff(current, last, deletions=False)
    tables.write("documents", store.apply_diff(current, last, changes))


def start_ingest(stream: DataFrame, tables: store.Store, checkpoint: str, weights: Mapping[str, float] | None = None):
    """A streaming query that ingests ``collection, path, hash, modified_at, ...`` rows, and postings if given weights."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        ingest_batch(tables, rows)
        if weights:
            upsert_postings(tables, rows.withColumn("active", F.lit(True)), weights)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def with_expiry(cache: DataFrame, ttl_seconds: int, time: str = "created_at") -> DataFrame:
    """Entries of a response cache that are still fresh."""
    return cache.where(F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col(time)) > F.current_timestamp())
