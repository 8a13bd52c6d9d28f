"""Event counts and pauses on unbounded inputs; the same definitions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import seconds
from ..schema import StreamSchema


def _interval(text: str) -> str:
    return f"{seconds(text):g} seconds"


def windowed_counts(events: DataFrame, schema: StreamSchema, width: str, slide: str | None = None, late: str = "10m") -> DataFrame:
    """Events by name in tumbling or sliding windows; rows later than ``late`` are left out by the watermark."""
    window = F.window(schema.timestamp_col, _interval(width), _interval(slide)) if slide else F.window(schema.timestamp_col, _interval(width))
    return events.withWatermark(schema.timestamp_col, _interval(late)).groupBy(window.alias("window"), F.col(schema.event_col).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def live_sessions(events: DataFrame, schema: StreamSchema, timeout: str, late: str = "10m") -> DataFrame:
    """Sessions of a path ended by a pause: start, end, events.  A pause of exactly ``timeout`` doesn't end one."""
    pause = F.session_window(schema.timestamp_col, f"{int(seconds(timeout) * 1e6) + 1} microseconds")
    return events.withWatermark(schema.timestamp_col, _interval(late)).groupBy(pause.alias("session"), *schema.path_cols).agg(F.count(F.lit(1)).alias("n_events"), F.min(schema.timestamp_col).alias("first_time"), F.max(schema.timestamp_col).alias("last_time"))
