"""Event-time windows, sessions and the login lock over a stream of events (user_id, ts, event_type)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """``ts`` as an instant, with a watermark where the frame is a stream."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late and events.isStreaming else out


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    own = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return own.select(F.col("w.start").alias("starts"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str = "2 hours") -> DataFrame:
    own = timed(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return own.select(F.col("w.start").alias("starts"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events with less than the gap between them."""
    own = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return own.select("user_id", F.col("w.start").alias("starts"), "events")


def locked_out(events: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """(user_id, event_id, outcome) of login attempts: ok, failed, locked (this failure locks) or rejected (while locked).

    A failure is an ``error``, a success a ``signup``. A success clears the count; attempts during a lock change
    nothing; the count outlasts the lock, so that the next failure locks again at once. The lock gates the counting, so
    the attempts of a user are gone through in order: a small state for each user, for any number of attempts.
    """

    def follow(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures, until, user = 0, None, None
        for batch in groups:
            out = []
            for who, event, at, kind in zip(batch.user_id, batch.event_id, batch.ts, batch.event_type, strict=True):
                if who != user:
                    user, failures, until = who, 0, None
                if until is not None and at < until:
                    out.append("rejected")
                elif kind == "signup":
                    failures, until = 0, None
                    out.append("ok")
                else:
                    failures += 1
                    until = at + pd.Timedelta(seconds=seconds) if failures >= most else None
                    out.append("locked" if failures >= most else "failed")
            yield pd.DataFrame({"user_id": batch.user_id, "event_id": batch.event_id, "outcome": out})

    attempts = timed(events).where(F.col("event_type").isin("error", "signup")).select("user_id", "event_id", "ts", "event_type")
    return attempts.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(follow, "user_id long, event_id long, outcome string")
