"""Hybrid search: fusing keyword and vector lists, reranking the first ten, blending by rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import bm25, fusion

RERANKED = 10
MISSING_SCORE = 0.5
#: A reranker maps a page to ``key, rerank`` with scores from 0 to 1.
Reranker = Callable[[DataFrame], DataFrame]


def fuse_and_rerank(keyword: DataFrame, near: DataFrame, reranker: Reranker | None, key: str = "id", min_score: float = 0.0, limit: int | None = None, tie: int | None = None) -> DataFrame:
    """``key, score`` of two ranked lists (``key, rank``), best first.

    ``tie`` is the number of decimals within which scores count as equal and go by key.
    """
    by = F.round("score", tie) if tie is not None else F.col("score")
    fused = bm25.top(fusion.rrf(keyword, near, key), RERANKED if reranker else limit, F.desc(by), F.col(key))
    if reranker is not None:
        rows = fusion.ranked(fused, F.desc(by), F.col(key)).withColumn("rank", F.col("rank") + 1)
        scored = rows.join(F.broadcast(reranker(rows)), key, "left")
        rerank = F.coalesce("rerank", F.lit(MISSING_SCORE))
        fused = scored.withColumn("score", fusion.blend(F.col("score"), rerank, F.col("rank"))).select(key, "score")
    return bm25.top(fused.where(F.col("score") >= min_score), limit, F.desc("score"), F.col(key))


def rerank_text(title: Column, category: Column, difficulty: Column, summary: Column, keywords: Column, body: Column) -> Column:
    """What a reranker reads of a document: lines of what it has, and 300 bytes of body."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    start = F.regexp_replace(F.decode(F.substring(F.encode(body, "utf-8"), 1, 300), "utf-8"), "�+$", "")
    return F.concat_ws("\n", line("Title", title), line("Category", category), line("Difficulty", difficulty), line("Summary", summary), line("Keywords", F.array_join(keywords, ", ")), start)


def overlap_reranker(query: str, text: str = "text", key: str = "id") -> Reranker:
    """A stand-in for a model: the share of the query's words that a row's text holds."""
    words = sorted(set(X.sanitise_query(query).lower().split())) or [""]

    def score(rows: DataFrame) -> DataFrame:
        own = X.tokens(F.col(text))
        return rows.select(key, (F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / len(words)).alias("rerank"))

    return score
