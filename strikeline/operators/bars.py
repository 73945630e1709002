"""Bars: ticks to intervals, minutes to sessions, and one row per timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(ticks: DataFrame, key: str, bucket: Column, price: str, order: tuple[str, ...]) -> DataFrame:
    """Open, high, low, close and count per key and bucket; first and last by ``order`` (partial aggregation)."""
    at = F.struct(*order)
    return ticks.groupBy(F.col(key).alias("instrument_id"), bucket.alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").alias("volume"),
    )


def sessionize(minutes: DataFrame, tz: str = "Asia/Kolkata", first: int = 555, last: int = 930) -> DataFrame:
    """Daily bars of minute bars (instrument_id, ts in UTC, open..close) inside the local session, bounds included."""
    local = F.from_utc_timestamp("ts", tz)
    minute = F.hour(local) * 60 + F.minute(local)
    at = F.col("ts")
    inside = minutes.withColumn("session", F.to_date(local)).where(minute.between(first, last))
    return inside.groupBy("instrument_id", "session").agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.count("*").alias("minutes"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key; ``order`` breaks ties."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str], name: str = "is_duplicate") -> DataFrame:
    """Mark the second and later rows of a key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def guard_prices(df: DataFrame) -> DataFrame:
    """Per instrument: rows with a price not above zero, and rows whose high or low does not hold the others."""
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return df.groupBy("instrument_id").agg(
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("nonpositive"),
        F.count_if((F.col("high") < high) | (F.col("low") > low)).alias("inconsistent"),
        F.count("*").alias("n_rows"),
    )


def order_violations(df: DataFrame, key: str = "instrument_id", at: str = "ts", order: str = "source_row") -> DataFrame:
    """Rows whose time is not after that of the row before, in source order."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__b", before).groupBy(key).agg(F.count_if(F.col(at) <= F.col("__b")).alias("violations"), F.count("*").alias("n_rows"))
