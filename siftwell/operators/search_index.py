"""A kept BM25 index: generations of postings in a store, searched without reading a document.

A posting holds its row's hits in every field and its length, so scoring needs no other table but one row of
totals. Postings are stored by bucket of their term, a common term in several files by its rows, and a query
reads its terms' buckets only. An update appends the postings of what changed as a new generation and marks
older ones of the same rows as dead; :meth:`SearchIndex.compact` drops them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import bm25
from siftwell.operators.store import Store

MOST_LISTED = 256  # distinct terms of queries that are pushed to the scan as a list; more are joined


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class SearchIndex:
    """The index ``name`` of a store. ``weights`` are those of the fields; ``key`` is the rows' id."""

    def __init__(self, tables: Store, weights: Mapping[str, float] = bm25.DOCUMENT_WEIGHTS, name: str = "index", key: str = "id", buckets: int = 64, parts: int = 4):
        self.tables, self.weights, self.name, self.key, self.buckets, self.parts = tables, dict(weights), name, key, buckets, parts

    def exists(self) -> bool:
        return self.tables.exists(f"{self.name}_totals")

    # -- writing

    def _entries(self, rows: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
        post, gen = bm25.entries(rows, list(self.weights), self.key), F.lit(generation).alias("gen")
        lengths = bm25.lengths(rows, list(self.weights), self.key).select(self.key, F.col("len").cast("int").alias("len"), gen)
        return post.select(_bucket(F.col("term"), self.buckets).alias("bucket"), "term", self.key, "hits", "len", gen), lengths

    def _write(self, name: str, rows: DataFrame, append: bool, by_bucket: bool = False) -> None:
        if by_bucket:
            part = F.pmod(F.xxhash64(self.key), F.lit(self.parts))
            # a bucket's part that outgrows Spark's advisory size is split further, however few buckets and parts there are
            rows = rows.withColumn("__part", part).hint("rebalance", "bucket", "__part").sortWithinPartitions("bucket", "term", self.key).drop("__part")
        write = self.tables.append if append else self.tables.write
        write(f"{self.name}_{name}", rows, ["bucket"] if by_bucket else ())

    def build(self, rows: DataFrame) -> "SearchIndex":
        """Index ``rows`` anew."""
        post, lengths = self._entries(rows, 0)
        self._write("postings", post, False, True)
        self._write("lengths", lengths, False)
        self._write("dead", lengths.select(self.key, F.lit(0).alias("below")).limit(0), False)
        return self._total(0)

    def update(self, changed: DataFrame) -> "SearchIndex":
        """Replace what ``changed`` rows have in the index; rows that aren't active are only taken out."""
        if not self.exists():
            return self.build(changed.where("active") if "active" in changed.columns else changed)
        gen = self._totals()["gen"] + 1
        live = changed.where("active") if "active" in changed.columns else changed
        post, lengths = self._entries(live, gen)
        # older generations die first: a reader in between misses a row, but sees none twice
        self._write("dead", changed.select(self.key, F.lit(gen).alias("below")).distinct(), True)
        self._write("postings", post, True, True)
        self._write("lengths", lengths, True)
        return self._total(gen)

    def compact(self) -> "SearchIndex":
        """Drop the dead postings; what is left is generation 0."""
        post, lengths = self._alive("postings"), self._alive("lengths")
        self._write("postings", post.withColumn("gen", F.lit(0)), False, True)
        self._write("lengths", lengths.withColumn("gen", F.lit(0)), False)
        self._write("dead", self.tables.read(f"{self.name}_dead").limit(0), False)
        return self._total(0)

    def _total(self, gen: int) -> "SearchIndex":
        alive = self._alive("lengths")
        self._write("totals", alive.agg(F.count("*").alias("n_rows"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"), F.lit(gen).alias("gen")), False)
        return self

    # -- reading

    def _totals(self) -> dict:
        return self.tables.read(f"{self.name}_totals").first().asDict()

    def _alive(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        rows = self.tables.read(f"{self.name}_{name}") if rows is None else rows
        dead = self.tables.read(f"{self.name}_dead").groupBy(F.col(self.key).alias("__dead")).agg(F.max("below").alias("below"))
        return rows.join(dead, (F.col(self.key) == F.col("__dead")) & (F.col("gen") < F.col("below")), "left_anti")

    def _hits(self, terms: Sequence[str] | None, asked: DataFrame | None = None, small: bool = False) -> DataFrame:
        """``term, key, f, len``: weighted hits of the terms' live postings."""
        rows = self.tables.read(f"{self.name}_postings")
        if terms is not None:
            frame = self.tables.spark.createDataFrame([(t,) for t in terms], "term string")
            buckets = sorted({r[0] for r in frame.select(_bucket(F.col("term"), self.buckets)).collect()}) if terms else []
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        elif asked is not None:
            asked = asked.select(_bucket(F.col("term"), self.buckets).alias("bucket"), "term").distinct()
            rows = rows.join(F.broadcast(asked) if small else asked, ["bucket", "term"], "left_semi")
        f = sum((F.lit(float(w)) * F.col("hits")[i] for i, w in enumerate(self.weights.values())), F.lit(0.0))
        return self._alive("postings", rows).select("term", self.key, f.alias("f"), "len")

    def score(self, terms: DataFrame, qid: str = "query_id") -> DataFrame:
        """``qid, key, relevance`` of every row that holds all of a query's terms; ``terms`` is what
        :func:`bm25.query_terms` gives."""
        distinct = [r["term"] for r in terms.select("term").distinct().limit(MOST_LISTED + 1).collect()]
        listed, small = len(distinct) <= MOST_LISTED, bm25.is_small(terms)
        hits = self._hits(sorted(distinct)) if listed else self._hits(None, terms, small)
        totals = self._totals()
        stats = self.tables.spark.range(1).select(F.lit(totals["n_rows"]).alias("n_rows"), F.lit(totals["avgdl"] or 1.0).alias("avgdl"))
        return bm25.relevance(hits, terms, stats, small, self.key, qid)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """``key, relevance`` of one query, best first."""
        terms = sorted(set(bm25._driver_tokens(query)))
        frame = self.tables.spark.createDataFrame([(0, t, len(terms)) for t in terms], "query_id long, term string, n_terms int")
        return bm25.top(self.score(frame).select(self.key, "relevance"), limit, F.desc("relevance"), F.col(self.key))

    def batch(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """``query_id, key, relevance, rank`` of many queries (query_id, query) in one plan."""
        scored = self.score(bm25.query_terms(queries, analyse=X.tokens))
        return bm25.top_per_query(scored, limit, F.desc(F.round("relevance", 9)), F.col(self.key))
