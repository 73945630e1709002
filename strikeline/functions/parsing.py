"""Tolerant parsing of source text: numbers, dates, timestamps, headers, identifiers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing number.
NULL_TOKENS = ("", "-", "NA", "N/A")
WIDE_NULL_TOKENS = (*NULL_TOKENS, "null", "None")
# Accepted layouts of dates, tried in this order.
DATE_FORMATS = ("d-MMM-yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yyyy")
DATETIME_FORMATS = ("yyyy-M-d H:m:s", "d-M-yyyy H:m:s", "d/M/yyyy H:m:s", "yyyy/M/d H:m:s", "d-MMM-yyyy H:m:s")


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).lower()


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> dict[str, str]:
    """Canonical name -> source column; the first alias that is there wins, whatever its case and spacing."""
    there = {collapse(c): c for c in columns}
    found = {name: next((there[collapse(a)] for a in own if collapse(a) in there), None) for name, own in aliases.items()}
    if missing := [name for name in required if not found.get(name)]:
        raise ValueError(f"missing required columns: {missing}")
    return {name: c for name, c in found.items() if c}


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing required columns: {missing}")
    return df


def quoted(name: str) -> Column:
    """A source column whose name may hold dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_number(x: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Null tokens to null, thousands commas removed; any other text that is no number is an error."""
    t = F.trim(x)
    return F.when(t.isin(*tokens), None).otherwise(F.replace(t, F.lit(","), F.lit("")).cast("double"))


def coerce_number(x: Column) -> Column:
    """What is no number becomes null."""
    value = x.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_date(x: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first layout that fits, as midnight; null if none does."""
    t = F.trim(x)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def parse_date_strict(x: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.when(x.isNull() | x.isin(*NULL_TOKENS), None).otherwise(F.coalesce(parse_date(x, formats), F.raise_error(F.concat(F.lit("not a date: "), x)).cast("timestamp")))


def parse_timestamp(text: Column, time: Column | None = None, source_tz: str = "UTC") -> Column:
    """ISO text first (an offset counts, else ``source_tz``), then date and time in the known layouts."""
    t = F.trim(text)
    zoned = t.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    naive = F.coalesce(
        F.when(zoned, None).otherwise(t.try_cast("timestamp_ntz")),
        *(F.try_to_timestamp(F.concat_ws(" ", t, F.coalesce(F.trim(time), F.lit("00:00:00")) if time is not None else F.lit("00:00:00")), F.lit(f)).cast("timestamp_ntz") for f in DATETIME_FORMATS),
        *(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in DATETIME_FORMATS),
    )
    if time is not None:
        joined = F.concat_ws(" ", t, F.trim(time)).try_cast("timestamp_ntz")
        naive = F.when(F.length(t) <= 10, F.coalesce(joined, naive)).otherwise(naive)
    return F.coalesce(F.when(zoned, t.try_cast("timestamp")), local_to_utc(naive.cast("timestamp"), source_tz))


def local_to_utc(naive: Column, tz: str) -> Column:
    """A local time as an instant; null for local times that a zone skips or has twice."""
    at = F.to_utc_timestamp(naive, tz)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(at + hour, tz) == naive) | (F.from_utc_timestamp(at - hour, tz) == naive)
    return F.when((F.from_utc_timestamp(at, tz) == naive) & ~twice, at)


def number_text(x: Column) -> Column:
    """A number without a trailing .0 when it is integral."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def instrument_id(symbol: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """symbol|yyyy-MM-dd|option type or instrument|strike."""
    return F.concat_ws("|", symbol, F.date_format(expiry, "yyyy-MM-dd"), kind, number_text(strike))


def route(day: Column, cutover: str = "2024-07-08") -> Column:
    """Which archive layout a trading day has."""
    return F.when(day >= F.lit(cutover).cast("date"), "udiff").otherwise("legacy")
