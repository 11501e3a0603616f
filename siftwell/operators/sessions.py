"""Sessions, what they have seen, memories and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X

#: Fixed values of sessions and suggestions.
DEMOTION, LOGGED, MARKED, TTL_SECONDS = 0.3, 5, 10, 3600
TOP_ROWS, DIRECTORY_FACTOR, DIRECTORY_CAP = 3, 1.15, 1.0
MOST_DIRECTORIES, MOST_CONCEPTS, MOST_REFINEMENTS = 5, 10, 3
CATEGORIES = ("preference", "entity", "pattern", "fact")
MOST_LOGGED = 50  # queries of a session that memories are extracted from


def log_row(page: DataFrame, session: str, query: str) -> DataFrame:
    """One log row of a result page (hash, ord): ``session_id, query, result_count, top_results``."""
    top = page.where(F.col("ord") < LOGGED).agg(F.sort_array(F.collect_list(F.struct("ord", "hash"))).alias("t"))
    return page.agg(F.count("*").alias("result_count")).crossJoin(top).select(F.lit(session).alias("session_id"), F.lit(query).alias("query"), "result_count", F.transform("t", lambda x: x["hash"]).alias("top_results"))


def top_queries(log: DataFrame, n: int = LOGGED, session: str = "session", order: Sequence[Column] = ()) -> DataFrame:
    """The latest ``n`` queries of each session in an array, latest first. ``log`` has session, query, created_at, event_id."""
    w = Window.partitionBy(session).orderBy(*(order or (F.desc("created_at"), F.desc("event_id"))))
    ranked = log.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return ranked.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "query"))), lambda x: x["query"]).alias("queries"))


def mark_seen(seen: DataFrame, page: DataFrame, session: str) -> DataFrame:
    """The seen table with a page's first rows; later marks replace earlier ones."""
    fresh = page.where(F.col("ord") < MARKED).select(F.lit(session).alias("session_id"), F.col("hash").alias("document_hash"), F.current_timestamp().alias("seen_at"))
    both = seen.select("session_id", "document_hash", "seen_at").unionByName(fresh)
    return both.groupBy("session_id", "document_hash").agg(F.max("seen_at").alias("seen_at"))


def demote_seen(page: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Rows already seen at 0.3 of their score, sorted again; ``seen`` has one column of keys."""
    marks = seen.select(F.col(seen.columns[0]).alias(key)).distinct().withColumn("seen", F.lit(True))
    scored = page.join(marks, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return scored.withColumn("score", F.when(F.col("seen"), F.col("score") * DEMOTION).otherwise(F.col("score"))).orderBy(F.desc("score"), key)


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions whose time to live has passed since their last activity."""
    return sessions.where(F.timestamp_add("SECOND", F.col("ttl_seconds").cast("int"), F.col("last_active_at")) < now)


def directory_boost(page: DataFrame) -> DataFrame:
    """Rows below the first three in one of those three's folders at 1.15 of their score, at most 1."""
    rows = page.withColumn("dir", X.parent_dir(F.col("path")))
    top = rows.where(F.col("ord") < TOP_ROWS).select("dir").distinct().withColumn("__top", F.lit(True))
    joined = rows.join(F.broadcast(top), "dir", "left")
    better = F.least(F.col("score") * DIRECTORY_FACTOR, F.lit(DIRECTORY_CAP))
    return joined.withColumn("score", F.when((F.col("ord") >= TOP_ROWS) & F.col("__top"), better).otherwise(F.col("score"))).drop("__top", "dir").orderBy(F.desc("score"), "id")


def related_directories(page: DataFrame, n: int = MOST_DIRECTORIES) -> DataFrame:
    """``dir`` of a page's rows in order of first occurrence."""
    return page.where(F.col("filepath").contains("/")).groupBy(X.parent_dir(F.col("filepath")).alias("dir")).agg(F.min("ord").alias("first")).orderBy("first").limit(n)


def related_concepts(page: DataFrame, n: int = MOST_CONCEPTS) -> DataFrame:
    words = page.select("ord", F.posexplode("keywords").alias("at", "concept"))
    return words.groupBy("concept").agg(F.min(F.struct("ord", "at")).alias("first")).orderBy("first").limit(n).select("concept")


def refinements(query: str, concepts: Sequence[str]) -> list[str]:
    """Queries with one of the first three concepts added, unless the query has it."""
    return [f"{query} {c}" for c in list(concepts)[:MOST_REFINEMENTS] if c.lower() not in query.lower()]


def unseen_related(documents: DataFrame, directories: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: how many documents under the folders the session hasn't seen. ``directories`` is a page."""
    full = documents.where("active").withColumn("__full", F.concat("collection", F.lit("/"), "path"))
    dirs = directories.select(F.regexp_replace("dir", "^" + X.SCHEME, "").alias("__dir"))
    under = full.join(F.broadcast(dirs), F.col("__full").startswith(F.col("__dir")))
    return under.join(seen.select(F.col(seen.columns[0]).alias("hash")), "hash", "left_anti").agg(F.count("*").alias("unseen_related"))


# -- memories ---------------------------------------------------------------------------------------


def upsert_memories(facts: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each content: the first id and category, the highest confidence, repeats counted.

    ``facts`` has id, category, content, confidence and an order.
    """
    return (
        facts.withColumn("content_hash", F.sha2("content", 256))
        .groupBy("content_hash")
        .agg(
            F.min_by("id", order).alias("id"),
            F.min_by("category", order).alias("category"),
            F.min_by("content", order).alias("content"),
            F.max("confidence").alias("confidence"),
            (F.count("*") - 1).alias("access_count"),
            F.max(order).alias("updated"),
        )
    )


def memory_stats(memories: DataFrame) -> DataFrame:
    """``category, n, mean_confidence`` with a row for the total."""
    return memories.rollup("category").agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")).withColumn("category", F.coalesce("category", F.lit("total")))


def memory_page(memories: DataFrame, limit: int, offset: int = 0, category: str | None = None) -> DataFrame:
    if category is not None:
        memories = memories.where(F.col("category") == category)
    return memories.orderBy(F.desc("updated"), "id").offset(offset).limit(limit)


def valid_memories(extracted: DataFrame) -> DataFrame:
    """Extracted facts that may be stored: a known category, some content, a confidence within 0 and 1."""
    return extracted.where(F.col("category").isin(*CATEGORIES) & (F.col("content") != "") & F.col("confidence").between(0.0, 1.0))


def parse_memories(responses: DataFrame, response: str = "response") -> DataFrame:
    """Rows with ``category, content, confidence`` of each valid fact in a response: a JSON list, which other text
    may surround. What isn't such a list gives none."""
    body = F.regexp_extract(F.col(response), r"(?s)\[.*\]", 0)
    kind = "array<struct<category:string,content:string,confidence:double>>"
    facts = responses.withColumn("__fact", F.explode(F.from_json(body, kind)))
    return valid_memories(facts.select("*", "__fact.*").drop("__fact", response))


def merge_memories(stored: DataFrame, facts: DataFrame, order: str = "ord") -> DataFrame:
    """The memories table after facts came: a known content keeps its id and category, takes the higher
    confidence, and counts each repeat; new contents are added. ``facts`` as for :func:`upsert_memories`,
    ``stored`` has content_hash, id, category, content, confidence, access_count, updated."""
    fresh = upsert_memories(facts, order)
    was = stored.select(*[F.col(c).alias(f"was_{c}") for c in ("content_hash", "id", "category", "content", "confidence", "access_count", "updated")])
    both = was.join(fresh, F.col("was_content_hash") == F.col("content_hash"), "full_outer")
    known, came = F.col("was_content_hash").isNotNull(), F.col("content_hash").isNotNull()
    return both.select(
        F.coalesce("was_content_hash", "content_hash").alias("content_hash"),
        *[F.coalesce(f"was_{c}", c).alias(c) for c in ("id", "category", "content")],
        F.greatest("was_confidence", "confidence").alias("confidence"),
        F.when(known & came, F.col("was_access_count") + F.col("access_count") + 1).otherwise(F.coalesce("was_access_count", "access_count")).alias("access_count"),
        F.coalesce("updated", "was_updated").alias("updated"),
    )
