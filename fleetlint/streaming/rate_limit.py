"""Request-rate checks over an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: advised requests per minute ------------------------------

AUTH_PER_MINUTE = 10
API_PER_MINUTE = 1000

# --- End of fixed values ----------------------------------------------------


def over_limit(events: DataFrame, keys: Sequence[str], limit: int, event_time: str = "ts",
               window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Keys that pass ``limit`` events in a tumbling window; works on streams and tables.

    Counts are summed before the shuffle, so a very busy key is no burden. Windows
    close when the watermark passes their end; later events are dropped.
    """
    counted = (
        events.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("w"), *keys)
        .agg(F.count("*").alias("requests"))
    )
    return counted.where(F.col("requests") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "requests")


def still_open(events: DataFrame, keys: Sequence[str], limit: int, event_time: str = "ts",
               window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """The windows that :func:`over_limit` over a stream of ``events`` has not emitted when its input ends.

    ``events`` is the table that the stream has read. Windows that end after the last event
    less ``delay`` are counted from it; together with the stream's rows all windows are there.
    """
    last = events.agg((F.max(event_time) - F.expr(f"INTERVAL {delay}")).alias("t")).first()["t"]
    recent = events if last is None else events.where(F.window(event_time, window)["end"] > F.lit(last))
    return over_limit(recent, keys, limit, event_time, window, delay)
