"""The versioned data contract: layers, their fields and keys, and the rules every layer obeys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

VERSION = "1.0"
MARKET_TZ = "Asia/Kolkata"

_KINDS = {"ts": T.TimestampType(), "d": T.DoubleType(), "s": T.StringType(), "l": T.LongType()}


@dataclass(frozen=True)
class Layer:
    """Fields as (name, kind); those not optional are required."""

    fields: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    optional: tuple[str, ...] = ()
    at: str = "timestamp"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _KINDS[k], n in self.optional) for n, k in self.fields])

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.fields if n not in self.optional)


_TIMES = (("timestamp", "ts"), ("available_at", "ts"))
_OHLC = tuple((n, "d") for n in ("open", "high", "low", "close"))
_CONTRACT = (("underlying_id", "s"), ("expiry", "ts"), ("strike", "d"), ("option_type", "s"))

LAYERS = {
    "underlying_eod": Layer((*_TIMES, ("instrument_id", "s"), *_OHLC, ("volume", "d"), ("session_id", "s"), ("adjusted_close", "d"), ("corporate_action_id", "s")), ("instrument_id", "timestamp"), ("adjusted_close", "corporate_action_id")),
    "option_eod": Layer(
        (*_TIMES, *_CONTRACT, *_OHLC, ("last_price", "d"), ("volume", "d"), ("open_interest", "d"), ("settlement", "d"), ("lot_size", "d"), ("bid", "d"), ("ask", "d"), ("mid", "d"), ("bid_size", "d"), ("ask_size", "d")),
        ("underlying_id", "expiry", "strike", "option_type", "timestamp"),
        ("bid", "ask", "mid", "bid_size", "ask_size"),
    ),
    "contract_master": Layer((("contract_id", "s"), *_CONTRACT, ("lot_size", "d"), ("effective_from", "ts"), ("effective_to", "ts"), ("available_at", "ts")), ("contract_id", "effective_from"), at="effective_from"),
    "india_vix": Layer((*_TIMES, ("close", "d")), ("timestamp",)),
    "risk_free": Layer((*_TIMES, ("tenor", "s"), ("rate", "d")), ("timestamp", "tenor")),
    "intraday_quotes_trades": Layer(
        (*_TIMES, ("instrument_id", "s"), ("event_sequence", "l"), *((n, "d") for n in ("bid", "ask", "bid_size", "ask_size", "trade_price", "trade_size")), ("trade_id", "s")),
        ("instrument_id", "timestamp", "event_sequence"),
        ("bid", "ask", "bid_size", "ask_size", "trade_price", "trade_size", "trade_id"),
    ),
}

# Rules and manifest fields that the contract names.
RULES = (
    "reject_negative_prices",
    "reject_crossed_quotes",
    "flag_stale_quotes",
    "detect_duplicates",
    "require_contract_metadata",
    "require_point_in_time_available_at",
    "preserve_raw_source",
    "record_excluded_observations",
)
MANIFEST_FIELDS = ("dataset_id", "snapshot_created_at", "source", "source_version", "preprocessing_version", "code_commit", "sha256", "row_count")


def check(layers: dict[str, Layer] = LAYERS) -> None:
    """Every layer has its temporal fields, a key made of its fields, and available_at."""
    for name, layer in layers.items():
        names = {n for n, _ in layer.fields}
        if missing := {layer.at, "available_at"} - set(layer.required):
            raise ValueError(f"layer {name} lacks {sorted(missing)}")
        if not layer.key or not set(layer.key) <= names:
            raise ValueError(f"layer {name} has no key of its own fields")
