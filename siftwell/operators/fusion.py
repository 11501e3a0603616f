"""Fusing ranked lists: reciprocal ranks, merges, rank bands, strong signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Bonus below a rank, and weights of fusion against reranking up to a rank.
BONUSES = ((3, 0.05), (10, 0.02))
BANDS = ((3, 0.75), (10, 0.60))
REST_BAND = 0.40
STRONG_SCORE, STRONG_GAP = 0.85, 0.15


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 0 over a result list, which is small by its limit."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def bonus(rank: Column) -> Column:
    return F.when(rank < BONUSES[0][0], BONUSES[0][1]).when(rank < BONUSES[1][0], BONUSES[1][1]).otherwise(F.lit(0.0))


def rrf(bm25: DataFrame, vector: DataFrame, key: str = "id") -> DataFrame:
    """``key, score`` of two ranked lists (``key, rank``): twice the weight and the rank's bonus for each list."""
    parts = bm25.select(key, (F.lit(2.0) / (RRF_K + F.col("rank") + 1) + bonus(F.col("rank"))).alias("s"), F.lit(0).alias("list")).unionByName(
        vector.select(key, (F.lit(1.0) / (RRF_K + F.col("rank") + 1) + bonus(F.col("rank"))).alias("s"), F.lit(1).alias("list"))
    )
    return parts.groupBy(key).agg(F.sum("s").alias("score"))


def concatenated(lists: Sequence[DataFrame]) -> DataFrame:
    """Result lists one after the other: ``ord`` from 0 over all of them. Each has ``rank``."""
    union = None
    for i, rows in enumerate(lists):
        own = rows.withColumn("step", F.lit(i))
        union = own if union is None else union.unionByName(own, allowMissingColumns=True)
    return union.withColumn("ord", F.row_number().over(Window.orderBy("step", "rank")) - 1)


def keep_first(rows: DataFrame, key: str | Sequence[str], order: str = "ord") -> DataFrame:
    """The first row of each key, in order."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def workflow_rrf(lists: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """One rank over the concatenated lists: ``key, score`` with 1 / (rank + 60) summed by key."""
    return concatenated(lists).groupBy(key).agg(F.sum(F.lit(1.0) / (F.col("ord") + RRF_K)).alias("score"), F.min("ord").alias("first"))


def merge_append(lists: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Lists in turn, each key once."""
    return keep_first(concatenated(lists), key)


def merge_interleave(lists: Sequence[DataFrame], key: str = "id", round_robin: bool = False) -> DataFrame:
    """As :func:`merge_append`; with ``round_robin`` the first of every list, then the second, and so on."""
    rows = concatenated(lists)
    if round_robin:
        rows = rows.withColumn("ord", F.row_number().over(Window.orderBy("rank", "step")) - 1)
    return keep_first(rows, key)


def band(rank: Column) -> Column:
    """Weight of the fused score at a rank from 1."""
    return F.when(rank <= BANDS[0][0], BANDS[0][1]).when(rank <= BANDS[1][0], BANDS[1][1]).otherwise(F.lit(REST_BAND))


def blend(score: Column, rerank: Column, rank: Column) -> Column:
    w = band(rank)
    return w * score + (1 - w) * rerank


def strong_signal(page: DataFrame) -> DataFrame:
    """One row ``top, gap, strong`` of a result page with ``score``."""
    two = page.orderBy(F.desc("score")).limit(2)
    row = two.agg(F.max("score").alias("top"), F.min("score").alias("second"), F.count("*").alias("n"))
    gap = F.when(F.col("n") > 1, F.col("top") - F.col("second"))
    return row.select("top", gap.alias("gap"), ((F.col("top") >= STRONG_SCORE) & (gap.isNull() | (gap >= STRONG_GAP)) & (F.col("n") > 0)).alias("strong"))


def normalise(rows: DataFrame) -> DataFrame:
    """Scores as a share of the largest."""
    best = rows.agg(F.max("score").alias("best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score"))).drop("best")
