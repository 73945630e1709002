"""Session bars over a stream: an extension of the batch sessionizer.

The state holds one row per instrument and session until the watermark passes
the session's end; late rows beyond it are dropped by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(ticks: DataFrame, tz: str = "Asia/Kolkata", first: int = 555, last: int = 930, late: str = "1 hour") -> DataFrame:
    """Daily bars of ticks (instrument_id, ts, seq, price) inside the local session."""
    local = F.from_utc_timestamp("ts", tz)
    minute = F.hour(local) * 60 + F.minute(local)
    at = F.struct("ts", "seq")
    inside = ticks.withWatermark("ts", late).where(minute.between(first, last))
    # windows of a day that begin at local midnight
    day = F.window("ts", "1 day", startTime=f"{-_offset_minutes(tz) % 1440} minutes")
    return inside.groupBy("instrument_id", day.alias("day")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("ticks"))


def _offset_minutes(tz: str) -> int:
    """The zone's offset; zones with daylight saving have none that windows could use."""
    import datetime as dt
    from zoneinfo import ZoneInfo

    offsets = {ZoneInfo(tz).utcoffset(dt.datetime(2024, m, 1)) for m in (1, 7)}
    if len(offsets) != 1:
        raise ValueError(f"{tz} changes its offset")
    return int(offsets.pop().total_seconds() // 60)
