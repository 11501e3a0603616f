"""Sessions over event streams: gap windows, seen rows, and state that expires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, gap_seconds: int, session: str = "session", time: str = "created_at", watermark: str | None = None) -> DataFrame:
    """``session, started, ended, last_event, n`` of activity without a pause of ``gap_seconds``; batch or stream."""
    rows = events.withWatermark(time, watermark) if watermark else events
    w = F.session_window(time, f"{gap_seconds} seconds")
    grouped = rows.groupBy(session, w.alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last_event"))
    return grouped.select(session, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "last_event", "n")


def first_seen(events: DataFrame, keys: list[str], time: str = "created_at", watermark: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: what a session hasn't seen before."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def recent_counts(events: DataFrame, width: str, slide: str | None = None, time: str = "created_at", key: str = "query", watermark: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows of event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, watermark).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n")


SESSION_STATE = "last_active timestamp, n long"
SESSION_OUT = "session string, n long, last_active timestamp, expired boolean"


def session_state(events: DataFrame, ttl_seconds: int = 3600, session: str = "session", time: str = "created_at"):
    """Live sessions with a time to live since their last event: a row when one changes and one when it expires."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "n": [n], "last_active": [last], "expired": [True]})
            return
        last, n = state.get if state.exists else (None, 0)
        for b in batches:
            newest = b[time].max().to_pydatetime()
            last, n = (newest if last is None or newest > last else last), n + len(b)
        state.update((last, n))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": [key[0]], "n": [n], "last_active": [last], "expired": [False]})

    rows = events.select(F.col(session).cast("string").alias(session), time).withWatermark(time, "0 seconds")
    return rows.groupBy(session).applyInPandasWithState(step, SESSION_OUT, SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout)
