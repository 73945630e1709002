"""Views that give the star-schema tables market shape, in DataFrames and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type."""
    ticks = table(spark, sf_dir, "events").where("value > 0")
    return B.bars(ticks, "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz"), "value", ("ts", "event_id"))


BARS = """bars AS (
  SELECT e.event_type AS instrument_id, date_trunc('hour', e.ts) AS ts, first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high,
    min(e.value) AS low, last(e.value ORDER BY e.ts, e.event_id) AS close, count(*) AS volume
  FROM events e WHERE e.value > 0 GROUP BY e.event_type, date_trunc('hour', e.ts)
)"""

RETURNS = (
    BARS
    + """, returns AS (
  SELECT instrument_id, ts, close, close / lag(close) OVER w - 1 AS ret, ln(close) - ln(lag(close) OVER w) AS log_ret
  FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
)"""
)


def option_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as option rows, some of them faulty."""
    day = F.to_date("l_shipdate")
    p, tax, disc = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        day.alias("trade_date"),
        F.date_add(day, F.col("l_quantity").cast("int") - 5).alias("expiry"),
        F.when(F.col("l_quantity") == 7, -p).otherwise(p).alias("strike"),
        F.when(F.col("l_returnflag") == "A", "CE").when(F.col("l_returnflag") == "R", "PE").when(F.col("l_linenumber") < 4, "XX").alias("option_type"),
        p.alias("open"),
        (p * (1 + tax)).alias("high"),
        (p * (1 - disc)).alias("low"),
        (p * (1 + tax - disc)).alias("close"),
        F.when(disc > 0, p).alias("last_price"),
        F.when(F.col("l_quantity") == 9, F.lit(-1.0)).otherwise(p).alias("settlement"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_quantity") - 1).alias("open_interest"),
        F.when(tax > 0, p).alias("underlying_price"),
        F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("double")).alias("lot_size"),
    )


PANEL = """panel AS (
  SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS trade_date, CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INT) - 5) AS expiry,
    CASE WHEN l_quantity = 7 THEN -l_extendedprice ELSE l_extendedprice END AS strike,
    CASE WHEN l_returnflag = 'A' THEN 'CE' WHEN l_returnflag = 'R' THEN 'PE' WHEN l_linenumber < 4 THEN 'XX' END AS option_type,
    l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (1 + l_tax - l_discount) AS close,
    CASE WHEN l_discount > 0 THEN l_extendedprice END AS last_price, CASE WHEN l_quantity = 9 THEN -1.0 ELSE l_extendedprice END AS settlement,
    l_quantity AS volume, l_quantity - 1 AS open_interest, CASE WHEN l_tax > 0 THEN l_extendedprice END AS underlying_price,
    CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS DOUBLE) END AS lot_size
  FROM lineitem
)"""


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations with text fields, so that every reason occurs."""
    x = table(spark, sf_dir, "lineitem")
    p = F.col("l_extendedprice")
    hours = lambda n: F.col("l_shipdate") + F.make_dt_interval(F.lit(0), n)
    return x.select(
        "*",
        F.col("l_shipdate").cast("string").alias("timestamp"),
        F.when(F.col("l_quantity") == 11, F.lit("soon")).otherwise(hours(F.col("l_linenumber") - 2).cast("string")).alias("available_at"),
        F.concat_ws("|", "l_orderkey", "l_linenumber").alias("instrument_id"),
        F.when(F.col("l_linenumber") < 7, F.lit("U")).alias("underlying_id"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 5).cast("string").alias("expiry"),
        F.when(F.col("l_quantity") == 13, F.lit(0.0)).otherwise(p).cast("string").alias("strike"),
        F.when(F.col("l_quantity") == 17, F.lit("n/a")).otherwise(p.cast("string")).alias("open"),
        (p * (1 + F.col("l_tax"))).alias("high"),
        F.when(F.col("l_quantity") == 19, 2 * p).otherwise(p * (1 - F.col("l_discount"))).alias("low"),
        p.alias("close"),
        F.when(F.col("l_quantity") == 23, F.lit(-1.0)).otherwise(F.col("l_quantity")).alias("volume"),
        F.col("l_quantity").alias("open_interest"),
        F.when(F.col("l_returnflag") == "A", "CE").when(F.col("l_returnflag") == "R", "PE").alias("option_type"),
    )


DECISION = "2000-06-01 00:00:00"
ROW_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

JUDGED = f"""rows AS (
  SELECT *, CAST(l_shipdate AS TIMESTAMP) AS t, CASE WHEN l_quantity <> 11 THEN l_shipdate + to_hours(l_linenumber - 2) END AS av,
    CAST(CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INT) - 5) AS TIMESTAMP) AS ex, l_orderkey || '|' || l_linenumber AS instrument_id, l_linenumber < 7 AS has_underlying,
    CASE WHEN l_quantity = 13 THEN 0.0 ELSE l_extendedprice END AS strike, CASE WHEN l_quantity <> 17 THEN l_extendedprice END AS open,
    l_extendedprice * (1 + l_tax) AS high, CASE WHEN l_quantity = 19 THEN 2 * l_extendedprice ELSE l_extendedprice * (1 - l_discount) END AS low, l_extendedprice AS close,
    CASE WHEN l_quantity = 23 THEN -1.0 ELSE l_quantity END AS volume, l_quantity AS oi
  FROM lineitem
), judged AS (
  SELECT l_orderkey, l_linenumber, instrument_id, list_sort(list_distinct(list_filter(
    CASE WHEN NOT has_underlying THEN ['MISSING_REQUIRED_FIELD'] WHEN av IS NULL THEN ['INVALID_TIMESTAMP'] ELSE [
      CASE WHEN av < t THEN 'AVAILABLE_BEFORE_OBSERVATION' END,
      CASE WHEN av > TIMESTAMP '{DECISION}' THEN 'LOOKAHEAD_AVAILABLE_AFTER_DECISION' END,
      CASE WHEN ex < t THEN 'EXPIRY_BEFORE_OBSERVATION' END,
      CASE WHEN open IS NULL THEN 'NON_NUMERIC_VALUE' WHEN least(open, high, low, close, strike, volume, oi) < 0 THEN 'NEGATIVE_VALUE' END,
      CASE WHEN open IS NOT NULL AND (high < low OR open < low OR open > high OR close < low OR close > high) THEN 'INVALID_OHLC_RANGE' END,
      CASE WHEN strike <= 0 THEN 'NON_POSITIVE_STRIKE' END,
      CASE WHEN volume < 0 OR oi < 0 THEN 'NEGATIVE_ACTIVITY' END,
      CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'INVALID_OPTION_TYPE' END] END
    || [CASE WHEN row_number() OVER (PARTITION BY t, instrument_id ORDER BY {", ".join(ROW_ORDER)}) > 1 THEN 'DUPLICATE_CANONICAL_KEY' END],
    lambda r: r IS NOT NULL))) AS reasons
  FROM rows
)"""


def contract_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contracts: some have two overlapping versions."""
    p = table(spark, sf_dir, "part")
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size") * 20)
    first = p.select(F.col("p_partkey").alias("contract_id"), start.cast("timestamp_ntz").alias("effective_from"), F.when(F.col("p_size") % 5 != 0, F.date_add(start, 700).cast("timestamp_ntz")).alias("effective_to"), F.col("p_size").cast("double").alias("lot_size"))
    second = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("contract_id"), F.date_add(start, 500).cast("timestamp_ntz").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), (F.col("p_size") * 2.0).alias("lot_size"))
    return first.unionByName(second).withColumn("available_at", F.col("effective_from"))


MASTER = """master AS (
  SELECT *, effective_from AS available_at FROM (
    SELECT p_partkey AS contract_id, CAST(DATE '1995-01-01' + p_size * 20 AS TIMESTAMP) AS effective_from,
      CASE WHEN p_size % 5 <> 0 THEN CAST(DATE '1995-01-01' + (p_size * 20 + 700) AS TIMESTAMP) END AS effective_to, CAST(p_size AS DOUBLE) AS lot_size
    FROM part
    UNION ALL
    SELECT p_partkey, CAST(DATE '1995-01-01' + (p_size * 20 + 500) AS TIMESTAMP), NULL, p_size * 2.0 FROM part WHERE p_size % 3 = 0
  )
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of contracts over the whole range of parts and a little beyond it."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), F.expr("o_custkey * 14 div 10").alias("contract_id"), F.col("o_orderdate").alias("ts"))


OBSERVATIONS = "observations AS (SELECT o_orderkey AS record_index, o_custkey * 14 // 10 AS contract_id, o_orderdate AS ts FROM orders)"
