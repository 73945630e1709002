"""Row quality: reason codes, reports, dataset checks.

A row's reasons are one array expression; two of them (a missing field, a bad
time) stop the others, as later rules need those fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions.parsing import coerce_number

# Fields that a row needs, fields that are numbers, and prices (the codes below are fixed too).
REQUIRED = ("timestamp", "available_at", "instrument_id", "underlying_id", "expiry", "strike", "open", "high", "low", "close", "volume", "open_interest")
CHECKED = ("open", "high", "low", "close", "strike", "volume", "open_interest")
PRICES = ("open", "high", "low", "close", "last_price", "settlement")
CONTRACT_KEY = ("trade_date", "expiry", "strike", "option_type")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def reasons(rows: DataFrame, decision: Column, order: list[str], keys: tuple[str, ...] = ("timestamp", "instrument_id")) -> DataFrame:
    """Add ``reasons``, the sorted distinct codes of each row (fields may be text or typed)."""
    when = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    ts, available, expiry = (_text(n).try_cast("timestamp") for n in ("timestamp", "available_at", "expiry"))
    num = {n: coerce_number(F.col(n)) for n in CHECKED}
    missing = F.exists(F.array(*(F.coalesce(_text(n), F.lit("")) for n in REQUIRED)), lambda v: v == "")
    bad_time = ts.isNull() | available.isNull() | expiry.isNull()
    # the first offending field decides between the two codes
    first = F.coalesce(*(F.when(num[n].isNull(), "NON_NUMERIC_VALUE").when(num[n] < 0, "NEGATIVE_VALUE") for n in CHECKED))
    low, high, op, cl = (num[n] for n in ("low", "high", "open", "close"))
    later = F.array(
        when(available < ts, "AVAILABLE_BEFORE_OBSERVATION"),
        when(available > decision, "LOOKAHEAD_AVAILABLE_AFTER_DECISION"),
        when(expiry < ts, "EXPIRY_BEFORE_OBSERVATION"),
        first,
        F.when(low.isNotNull() & high.isNotNull() & op.isNotNull() & cl.isNotNull(), when((high < low) | (op < low) | (op > high) | (cl < low) | (cl > high), "INVALID_OHLC_RANGE")),
        when(num["strike"] <= 0, "NON_POSITIVE_STRIKE"),
        when((num["volume"] < 0) | (num["open_interest"] < 0), "NEGATIVE_ACTIVITY"),
        when(~F.coalesce(F.col("option_type").isin("CE", "PE"), F.lit(False)), "INVALID_OPTION_TYPE"),
    )
    # a row's own codes come first, so that the window moves them and not what they were made of
    name = "own_reasons"
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    repeated = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1
    own = F.when(missing, F.array(F.lit("MISSING_REQUIRED_FIELD"))).when(bad_time, F.array(F.lit("INVALID_TIMESTAMP"))).otherwise(later)
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.col(name), F.array(when(repeated, "DUPLICATE_CANONICAL_KEY"))))))
    return rows.withColumn(name, own).withColumn("reasons", found).drop(name)


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def report(judged: DataFrame) -> DataFrame:
    """One row: rows, accepted, excluded, status."""
    bad = F.count_if(F.size("reasons") > 0)
    return judged.agg(F.count("*").alias("n_rows"), F.count_if(F.size("reasons") == 0).alias("accepted"), bad.alias("excluded"), F.when(bad > 0, "REJECT_ROWS").otherwise("PASS").alias("status"))


def snapshot_checks(panel: DataFrame, files: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row per check: name, value, hard, failed.  One aggregation, and one for repeated keys.

    ``files`` and ``errors`` have one row per file read and per file that could not be.
    """
    neg = F.lit(False)
    for p in PRICES:
        neg = neg | F.coalesce(F.col(p) < 0, F.lit(False))
    counts = {
        "rows": (F.count("*"), False),
        "non_option_type": (F.count_if(~F.coalesce(F.col("option_type").isin("CE", "PE"), F.lit(False))), True),
        "missing_trade_date": (F.count_if(F.col("trade_date").isNull()), True),
        "missing_expiry": (F.count_if(F.col("expiry").isNull()), True),
        "nonpositive_strike": (F.count_if(F.col("strike") <= 0), True),
        "expiry_before_trade": (F.count_if(F.col("expiry") < F.col("trade_date")), True),
        "negative_prices": (F.count_if(neg), True),
        "negative_volume": (F.count_if(F.col("volume") < 0), True),
        "negative_open_interest": (F.count_if(F.col("open_interest") < 0), True),
        "negative_lot_size": (F.count_if(F.col("lot_size") < 0), True),
        "zero_volume_rows": (F.count_if(F.col("volume") == 0), False),
        "zero_oi_rows": (F.count_if(F.col("open_interest") == 0), False),
        "missing_underlying": (F.count_if(F.col("underlying_price").isNull()), False),
        "missing_lot_size": (F.count_if(F.col("lot_size").isNull()), False),
        "ce_rows": (F.count_if(F.col("option_type") == "CE"), False),
        "pe_rows": (F.count_if(F.col("option_type") == "PE"), False),
        "unique_expiries": (F.count_distinct("expiry"), False),
        "unique_trade_dates": (F.count_distinct("trade_date"), False),
    }
    one = panel.agg(*(e.alias(n) for n, (e, _) in counts.items()))
    tall = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("value"), F.lit(hard).alias("hard")) for n, (_, hard) in counts.items())))
    rows = one.select(tall.alias("t")).select("t.*")
    keys = panel.groupBy(*CONTRACT_KEY).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("value"))
    rows = rows.unionByName(keys.select(F.lit("duplicate_contract_keys").alias("check"), "value", F.lit(True).alias("hard")))
    for name, table, hard in (("files", files, False), ("file_errors", errors, True)):
        count = panel.sparkSession.range(1).select(F.lit(0).cast("long").alias("value")) if table is None else table.agg(F.count("*").alias("value"))
        rows = rows.unionByName(count.select(F.lit(name).alias("check"), "value", F.lit(hard).alias("hard")))
    return rows.withColumn("failed", F.col("hard") & (F.col("value") > 0))


def exit_code(checks: DataFrame) -> int:
    """What a script that runs the checks should end with: 0 if none failed, else 1."""
    return int(checks.where("failed").limit(1).count() > 0)


def status(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("failed").alias("hard_failures"), F.when(F.count_if("failed") > 0, "FAIL").otherwise("PASS").alias("status"))


def quote_hygiene(quotes: DataFrame) -> DataFrame:
    """Crossed quotes, mids outside the spread, sizes not above zero, prices below zero, stale quotes (per instrument)."""
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(Window.partitionBy("instrument_id").orderBy("ts", "event_sequence")).cast("timestamp").cast("double")
    x = quotes.withColumn("__gap", gap)
    return x.groupBy("instrument_id").agg(
        F.count_if(F.col("bid") > F.col("ask")).alias("crossed"),
        F.count_if((F.col("mid") < F.col("bid")) | (F.col("mid") > F.col("ask"))).alias("mid_outside"),
        F.count_if((F.col("bid_size") <= 0) | (F.col("ask_size") <= 0)).alias("bad_size"),
        F.count_if((F.col("bid") < 0) | (F.col("ask") < 0)).alias("negative"),
        F.count_if(F.col("__gap") > 3600).alias("stale"),
    )
