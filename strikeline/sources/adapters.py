"""Adapters from source layouts to canonical layers.

An adapter names its source, fetches a window, normalises, validates and tells
where rows came from.  Header differences are settled when the plan is made; the
plan itself is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions import parsing as P
from strikeline.sources.files import read_csv

# Header names that stand for a canonical field, first match wins.
OHLC_ALIASES = {
    "timestamp": ("timestamp", "datetime", "date time", "date_time"),
    "date": ("date",),
    "time": ("time",),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close",),
    "volume": ("volume",),
}
OPTION_ALIASES = {
    "symbol": ("symbol", "underlying", "TckrSymb"),
    "instrument": ("instrument", "FinInstrmTp"),
    "trade_date": ("timestamp", "trade date", "trade_date", "date", "TradDt"),
    "expiry": ("expiry", "expiry_dt", "expiry date", "XpryDt"),
    "option_type": ("option type", "option_type", "optiontype", "opt_type", "option_typ", "OptnTp"),
    "strike": ("strike price", "strike_price", "strike", "strike_pr", "StrkPric"),
    "open": ("open", "open price", "open_price", "OpnPric"),
    "high": ("high", "high price", "high_price", "HghPric"),
    "low": ("low", "low price", "low_price", "LwPric"),
    "close": ("close", "close price", "close_price", "ClsPric"),
    "settlement": ("settle price", "settle_price", "daily settlement price", "settlement_price", "settle_pr", "SttlmPric"),
    "last_price": ("ltp", "last", "last price", "last_price", "LastPric"),
    "volume": ("no. of contracts", "no of contracts", "volume", "contracts", "TtlTradgVol"),
    "open_interest": ("open int", "open interest", "open interest(oi)", "oi", "open_int", "OpnIntrst"),
    "change_in_oi": ("change in oi", "change oi", "change_in_oi", "chg_in_oi", "ChngInOpnIntrst"),
    "underlying_price": ("underlying value", "underlying_value", "UndrlygPric"),
    "lot_size": ("lot size", "lot_size", "contract multiplier", "contract_multiplier", "NewBrdLotQty"),
    "turnover": ("TtlTrfVal",),
    "turnover_lakh": ("val_inlakh",),
}
OPTION_REQUIRED = ("symbol", "trade_date", "expiry", "strike", "open", "high", "low", "close", "volume", "open_interest")
LAKH = 100_000.0


class Adapter:
    """What every adapter answers to."""

    source_id = ""
    source_version = "1"

    def fetch_window(self, spark, path: str) -> DataFrame:
        return read_csv(spark, path)

    def normalize(self, raw: DataFrame) -> DataFrame:
        raise NotImplementedError

    def validate(self, rows: DataFrame, keys: tuple[str, ...] = ("timestamp", "instrument_id")) -> DataFrame:
        """Keys that occur more than once (none, if the rows are valid)."""
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

    def provenance(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"source_id": F.lit(self.source_id), "source_version": F.lit(self.source_version), "diagnostic_only": F.lit(True), "execution_backtest_allowed": F.lit(False)})


def _explicit_utc(text: str) -> Column:
    if not text.endswith("Z"):
        raise ValueError("a time of availability needs an explicit Z")
    return F.lit(text).cast("timestamp")


class OhlcAdapter(Adapter):
    """Open, high, low, close rows of one instrument; naive times are in ``source_tz``."""

    source_id = "ohlc-csv"

    def __init__(self, instrument_id: str, available_at: str, source_tz: str = "UTC"):
        self.instrument_id, self.available_at, self.source_tz = instrument_id, _explicit_utc(available_at), source_tz

    def normalize(self, raw: DataFrame) -> DataFrame:
        c = {k: P.quoted(v) for k, v in P.resolve(raw.columns, OHLC_ALIASES, ("open", "high", "low", "close")).items()}
        if "timestamp" not in c and "date" not in c:
            raise ValueError("missing required columns: ['timestamp' or 'date']")
        text = c.get("timestamp", c.get("date"))
        time = c.get("time") if "timestamp" not in c else None
        at = P.parse_timestamp(text, time, self.source_tz)
        at = F.coalesce(at, F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp"))
        num = lambda n: P.parse_number(c[n], P.WIDE_NULL_TOKENS) if n in c else F.lit(None).cast("double")
        return raw.select(at.alias("timestamp"), self.available_at.alias("available_at"), F.lit(self.instrument_id).alias("instrument_id"), *(num(n).alias(n) for n in ("open", "high", "low", "close", "volume")), F.date_format(at, "yyyy-MM-dd").alias("session_id"))


class OptionEodAdapter(Adapter):
    """End-of-day option and future rows, either archive layout or an export with long headers."""

    source_id = "derivatives-eod-csv"

    def __init__(self, available_at: str, symbol: str | None = None, options_only: bool = False):
        self.available_at, self.symbol, self.options_only = _explicit_utc(available_at), symbol, options_only

    def normalize(self, raw: DataFrame) -> DataFrame:
        found = P.resolve(raw.columns, OPTION_ALIASES, OPTION_REQUIRED)
        c = {k: P.quoted(v) for k, v in found.items()}
        none = lambda kind: F.lit(None).cast(kind)
        num = lambda n: P.parse_number(c[n]) if n in c else none("double")
        text = lambda n: F.nullif(F.upper(F.trim(c[n])), F.lit("")) if n in c else none("string")
        day, expiry = P.parse_date_strict(c["trade_date"]), P.parse_date_strict(c["expiry"])
        symbol, kind = text("symbol"), text("option_type")
        option = kind.isin("CE", "PE")
        turnover = num("turnover") if "turnover" in c else num("turnover_lakh") * LAKH
        rows = raw.select(
            day.alias("timestamp"),
            self.available_at.alias("available_at"),
            P.instrument_id(symbol, expiry, F.coalesce(F.when(option, kind), text("instrument"), F.lit("")), num("strike")).alias("instrument_id"),
            symbol.alias("underlying_id"),
            expiry.alias("expiry"),
            num("strike").alias("strike"),
            F.when(option, kind).alias("option_type"),
            F.when(option, "option").otherwise("future_or_other").alias("instrument_class"),
            *(num(n).alias(n) for n in ("open", "high", "low", "close", "last_price", "settlement", "volume", "open_interest", "change_in_oi", "underlying_price", "lot_size")),
            turnover.alias("turnover"),
            F.lit(found.get("last_price")).cast("string").alias("last_price_source"),
        )
        if self.symbol is not None:
            rows = rows.where(F.col("underlying_id") == self.symbol.upper())
        return rows.where("option_type IS NOT NULL") if self.options_only else rows

    @staticmethod
    def enrichment(rows: DataFrame) -> DataFrame:
        """Whether any row still needs its lot size from a contract master."""
        return rows.agg(F.coalesce(F.bool_or(F.col("lot_size").isNull()), F.lit(False)).alias("needs_contract_master"))
