"""Event-time windows over streams and tables alike (an extension; the dialect has none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by tumbling (or, with slide, sliding) windows of event time; late bounds a stream's state by a watermark.

    Rows with null time fall out, as windows have no place for them.
    """
    d = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = d.groupBy(w.alias("w"), *keys).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: tuple[str, ...], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by sessions that end after a gap without an event of the key."""
    d = events.withWatermark(time, late) if late else events
    out = d.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)
