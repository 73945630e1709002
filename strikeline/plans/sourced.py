"""Queries through sources, adapters and sinks: a table is written in a source's layout to the shared
folder, read back through the operator, and SQL states the same rows from the table itself."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from strikeline import schema
from strikeline.functions import parsing as P
from strikeline.operators import reconcile
from strikeline.plans import views as V
from strikeline.plans.catalog import _CHECK_SQL, _snapshot, register, rounded
from strikeline.sources import adapters, archive, files, shared, sinks

AVAILABLE = "2000-01-01T00:00:00Z"


def _csv(rows, spark, name):
    path = shared.fresh(spark, name)
    rows.write.option("header", True).csv(path)
    return path


# --- scans --------------------------------------------------------------------


@register("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 9) + 0.0 AS o_totalprice FROM orders")
def csv_scan(spark, sf):
    """Text columns behind a byte-order mark, required columns, tolerant numbers."""
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("﻿orderkey"), "o_custkey", "o_orderstatus", F.format_number("o_totalprice", 6).alias("o_totalprice"))
    raw = files.read_csv(spark, _csv(rows, spark, "orders-csv"), ("orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return rounded(raw.select(F.col("orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", P.parse_number(F.col("o_totalprice")).alias("o_totalprice")))


def _union(spark, sf):
    """Three layouts below one folder: two orders of columns, and one that lacks a column."""
    o, path = V.table(spark, sf, "orders"), shared.fresh(spark, "orders-union")
    whole = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("the status, of it"))
    layouts = {"F": whole, "O": whole.select("the status, of it", "o_custkey", "o_orderkey"), "P": whole.drop("o_custkey")}
    for status, rows in layouts.items():
        rows.where(F.col("the status, of it") == status).coalesce(1).write.option("header", True).csv(f"{path}/{status}")
    return files.read_csv_union(spark, f"{path}/*", ("o_orderkey", "o_custkey", "the status, of it"))


@register("SELECT o_orderkey, o_custkey, o_orderstatus AS status, true AS has_source FROM orders WHERE o_orderstatus IN ('F', 'O')")
def csv_union(spark, sf):
    rows, _ = _union(spark, sf)
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("the status, of it").alias("status"), (F.col("_source_file").endswith(".csv") & F.col("_artifact").contains("orders-union")).alias("has_source"))


@register("""SELECT 'missing required columns: [''o_custkey'']' AS error, 1::BIGINT AS n""")
def csv_union_errors(spark, sf):
    _, bad = _union(spark, sf)
    return bad.groupBy("error").agg(F.count("*").alias("n"))


def _envelope(spark, sf):
    path = shared.fresh(spark, "envelope") + ".json"
    rows = V.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    whole = rows.agg(F.to_json(F.struct(F.lit("nations").alias("source"), F.lit("1").alias("version"), F.array_sort(F.collect_list(F.struct("*"))).alias("records")))).first()[0]
    shared.write_text(spark, path, whole)
    return path


@register("SELECT n_nationkey, n_name, 'nations' AS source FROM nation")
def json_envelope(spark, sf):
    head, records = files.read_envelope(spark, _envelope(spark, sf))
    return records.select("n_nationkey", "n_name").crossJoin(F.broadcast(head.select("source")))


@register("SELECT 'dict' AS kind, 'records,source,version' AS keys, count(*) AS row_count, least(count(*), 3) AS sampled FROM nation")
def json_probe(spark, sf):
    found = files.probe_json(spark, _envelope(spark, sf))
    return found.select("kind", F.array_join(F.array_sort("keys"), ",").alias("keys"), F.col("row_count").cast("long").alias("row_count"), F.size("sample").cast("long").alias("sampled"))


_NAMES = "SELECT string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS t FROM part"


@register(f"SELECT strlen(t)::BIGINT AS bytes, sha256(t) AS sha256, split_part(t, chr(10), 1) AS first_line FROM ({_NAMES})")
def file_probe(spark, sf):
    names = V.table(spark, sf, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "\n"))
    path = shared.fresh(spark, "names") + ".txt"
    shared.write_text(spark, path, names.first()[0] + "\n")
    return files.probe(spark, path).select("bytes", "sha256", "first_line")


@register("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_nationkey, n_name FROM nation UNION ALL SELECT -1, 0, NULL, NULL")
def zipped_csv(spark, sf):
    """One archive per region, and one whose bytes are damaged."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("README.txt", "not this one")
            z.writestr("NATIONS.CSV", pdf.sort_values("n_nationkey")[["n_nationkey", "n_name"]].to_csv(index=False))
        return pd.DataFrame({"path": [str(pdf["n_regionkey"].iloc[0])], "content": [held.getvalue()]})

    nations = V.table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name")
    archives = nations.groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")
    archives = archives.unionByName(spark.range(1).select(F.lit("-1").alias("path"), F.lit(b"PK no archive").alias("content")))
    found = files.unzip_csv(archives)
    return found.select(F.col("path").cast("long").alias("n_regionkey"), "row", F.col("fields")["n_nationkey"].cast("long").alias("n_nationkey"), F.col("fields")["n_name"].alias("n_name"))


def _manifests(spark, sf):
    """A file per year and status: years with several statuses have several manifests."""
    o, path = V.table(spark, sf, "orders"), shared.fresh(spark, "manifests")
    rows = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("row_count"))
    rows = rows.withColumns({"source": F.when(F.col("status") == "P", "other").otherwise("orders archive"), "folder": F.col("status")})
    rows.write.partitionBy("folder", "year").json(path)
    found = files.read_manifests(spark, path, "orders", name="*.json")
    return found.withColumn("year", F.regexp_extract(F.input_file_name(), r"year=(\d+)", 1).cast("int"))


@register("SELECT year(o_orderdate) AS year, o_orderstatus AS status, count(*) AS row_count FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def manifests_found(spark, sf):
    return _manifests(spark, sf).select("year", "status", "row_count")


@register("SELECT year, count(*) AS n FROM (SELECT DISTINCT year(o_orderdate) AS year, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1 HAVING count(*) > 1")
def manifest_duplicate_years(spark, sf):
    return reconcile.duplicate_years(_manifests(spark, sf))


# --- the archive and manifests --------------------------------------------------

_FIRST, _LAST = "1995-01-01", "1995-12-31"
_DAYS_SQL = f"""WITH held AS (
  SELECT CAST(o_orderdate AS DATE) AS day, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1
), days AS (
  SELECT d.day, 'legacy' AS route, CASE WHEN content IS NULL OR isodow(d.day) = 2 THEN 'NO_ARCHIVE' ELSE 'VALIDATED' END AS status,
    CASE WHEN isodow(d.day) <> 2 THEN content END AS content, CASE WHEN isodow(d.day) = 3 THEN 1 ELSE 0 END AS tier
  FROM (SELECT CAST(unnest(range(DATE '{_FIRST}', DATE '{_LAST}' + 1, INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN held ON held.day = d.day
)"""


def _archive(spark, sf):
    """Every order day as a file: Tuesdays nowhere, Wednesdays only in the mirror; then the archive is read."""
    o = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    held = o.groupBy("day").agg(F.encode(F.array_join(keys, ","), "UTF-8").alias("content"))
    main, mirror = shared.fresh(spark, "archive"), shared.fresh(spark, "mirror")
    written = archive.write_raw(held.where("weekday(day) NOT IN (1, 2)"), main).unionByName(archive.write_raw(held.where("weekday(day) = 2"), mirror))
    assert written.agg(F.count("*")).first()[0]
    spark.dataSource.register(archive.ArchiveSource)
    reader = spark.read.format("daily_archive").option("start", _FIRST).option("end", _LAST)
    return reader.option("tiers", f"{main},{mirror}").option("daysPerTask", 31).load()


@register(f"{_DAYS_SQL} SELECT CAST(day AS VARCHAR) AS day, route, status, CASE WHEN status = 'VALIDATED' THEN tier END AS source_tier, strlen(content) AS bytes, sha256(content) AS sha256 FROM days")
def archive_days(spark, sf):
    return _archive(spark, sf).select(F.col("day").cast("string").alias("day"), "route", "status", "source_tier", "bytes", "sha256")


@register(
    f"""{_DAYS_SQL}, ids AS (SELECT string_agg(DISTINCT sha256(content), ',' ORDER BY sha256(content)) AS t FROM days WHERE content IS NOT NULL)
SELECT '{_FIRST}' AS first_day, '{_LAST}' AS last_day, count(*) AS row_count, count(*) FILTER (status = 'VALIDATED') AS validated, count(*) FILTER (status = 'NO_ARCHIVE') AS no_archive,
  0::BIGINT AS errors, (SELECT sha256(t) FROM ids) AS sha256, (SELECT sha256(t)[1:16] FROM ids) AS dataset_id, count(*) FILTER (status = 'VALIDATED') = 0 AS failed FROM days"""
)
def acquisition_manifest(spark, sf):
    found = archive.acquisition_manifest(_archive(spark, sf))
    return found.select(F.col("start").cast("string").alias("first_day"), F.col("end").cast("string").alias("last_day"), "row_count", "validated", "no_archive", "errors", "sha256", "dataset_id", "failed")


@register(
    """WITH f AS (SELECT string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}', ',' ORDER BY n_nationkey) AS r, count(*) AS n FROM nation),
t AS (SELECT '{"source":"nations","version":"1","records":[' || r || ']}' AS t, n FROM f)
SELECT sha256(t) AS sha256, sha256(t)[1:16] AS dataset_id, strlen(t)::BIGINT AS bytes, n AS row_count, 'shop' AS source, '7' AS source_version, 'abc' AS code_commit FROM t"""
)
def snapshot_manifest(spark, sf):
    found = archive.snapshot_manifest(spark, _envelope(spark, sf), "shop", "7", "abc")
    return found.select("sha256", "dataset_id", "bytes", "row_count", "source", "source_version", "code_commit")


# --- adapters -------------------------------------------------------------------

_STRIKE = "floor(l_extendedprice)"
_KIND = "CASE l_returnflag WHEN 'A' THEN 'CE' WHEN 'R' THEN 'PE' END"
_SYMBOL = "CASE WHEN l_linestatus = 'O' THEN 'ALPHA' ELSE 'BETA' END"
_EOD_SQL = f"""SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS trade_date, {_SYMBOL} AS underlying_id,
  {_SYMBOL} || '|' || CAST(CAST(l_receiptdate AS DATE) AS VARCHAR) || '|' || coalesce({_KIND}, 'FUTX') || '|' || CAST({_STRIKE} AS BIGINT) AS instrument_id,
  {_KIND} AS option_type, CASE WHEN {_KIND} IS NULL THEN 'future_or_other' ELSE 'option' END AS instrument_class,"""


def _raw_options(spark, sf):
    x = V.table(spark, sf, "lineitem").withColumn("l_receiptdate", F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int") * 7))
    symbol = F.when(F.col("l_linestatus") == "O", "Alpha ").otherwise("beta")
    kind = F.when(F.col("l_returnflag") == "A", "ce").when(F.col("l_returnflag") == "R", " PE").otherwise("")
    price = F.col("l_extendedprice").cast("string")
    common = {"symbol": symbol, "kind": kind, "strike": F.format_number(F.floor("l_extendedprice"), 0), "price": price}
    return x, common


_EOD_SOURCE = _EOD_SQL.replace("l_receiptdate", "(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT) * 7)")


@register(
    f"""{_EOD_SOURCE} round(l_extendedprice, 9) + 0.0 AS close, CASE WHEN l_discount > 0 THEN l_quantity END AS last_price, 'LAST' AS last_price_source,
  CASE WHEN l_tax > 0 THEN round(l_quantity * 100000.0, 6) END AS turnover, CAST(NULL AS DOUBLE) AS lot_size FROM lineitem"""
)
def legacy_options(spark, sf):
    """Archive headers of the old layout, with both LAST and LAST_PRICE: LAST comes first."""
    x, c = _raw_options(spark, sf)
    q = F.col("l_quantity").cast("string")
    raw = x.select(
        c["symbol"].alias("SYMBOL"), F.lit("futx").alias("INSTRUMENT"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("TIMESTAMP"), F.date_format("l_receiptdate", "dd-MMM-yyyy").alias("EXPIRY_DT"),
        c["kind"].alias("OPTION_TYP"), c["strike"].alias("STRIKE_PR"), *(c["price"].alias(n) for n in ("OPEN", "HIGH", "LOW", "CLOSE", "SETTLE_PR")), F.when(F.col("l_discount") > 0, q).otherwise("-").alias("LAST"),
        F.lit("1").alias("LAST_PRICE"), F.col("l_orderkey").cast("string").alias("CONTRACTS"), F.when(F.col("l_tax") > 0, q).otherwise("NA").alias("VAL_INLAKH"), F.col("l_linenumber").cast("string").alias("OPEN_INT"), F.lit("").alias("CHG_IN_OI"),
    )
    rows = adapters.OptionEodAdapter(AVAILABLE).normalize(raw)
    return _options(rows).select(*_OPTION, "close", "last_price", "last_price_source", F.round("turnover", 6).alias("turnover"), "lot_size")


_OPTION = ("l_orderkey", "l_linenumber", "trade_date", "underlying_id", "instrument_id", "option_type", "instrument_class")


def _options(rows):
    return rows.withColumns({"l_orderkey": F.col("volume").cast("long"), "l_linenumber": F.col("open_interest").cast("long"), "trade_date": F.date_format("timestamp", "yyyy-MM-dd"), "close": F.round("close", 9) + 0.0})


def _udiff(spark, sf):
    x, c = _raw_options(spark, sf)
    q = F.col("l_quantity").cast("string")
    return x.select(
        c["symbol"].alias("TckrSymb"), F.lit("futx").alias("FinInstrmTp"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("TradDt"), F.date_format("l_receiptdate", "yyyy-MM-dd").alias("XpryDt"), c["kind"].alias("OptnTp"),
        c["strike"].alias("StrkPric"), *(c["price"].alias(n) for n in ("OpnPric", "HghPric", "LwPric", "ClsPric", "SttlmPric", "LastPric")), F.col("l_orderkey").cast("string").alias("TtlTradgVol"),
        F.col("l_linenumber").cast("string").alias("OpnIntrst"), F.lit("3").alias("ChngInOpnIntrst"), c["price"].alias("UndrlygPric"), F.when(F.col("l_tax") > 0, q).otherwise("").alias("NewBrdLotQty"), q.alias("TtlTrfVal"),
    )


@register(f"""{_EOD_SOURCE} round(l_extendedprice, 9) + 0.0 AS close, 'LastPric' AS last_price_source, CASE WHEN l_tax > 0 THEN l_quantity END AS lot_size, l_quantity AS turnover FROM lineitem WHERE {_SYMBOL} = 'ALPHA' AND {_KIND} IS NOT NULL""")
def udiff_options(spark, sf):
    """The new layout: one symbol, whatever its case, and options only."""
    rows = adapters.OptionEodAdapter(AVAILABLE, symbol="alpha", options_only=True).normalize(_udiff(spark, sf))
    return _options(rows).select(*_OPTION, "close", "last_price_source", "lot_size", "turnover")


@register("SELECT bool_or(l_tax <= 0) AS needs_contract_master FROM lineitem")
def needs_contract_master(spark, sf):
    adapter = adapters.OptionEodAdapter(AVAILABLE)
    return adapter.enrichment(adapter.normalize(_udiff(spark, sf)))


@register(f"SELECT 'derivatives-eod-csv' AS source_id, '1' AS source_version, true AS diagnostic_only, false AS execution_backtest_allowed, '{AVAILABLE[:10]}' AS available, count(*) AS n FROM lineitem")
def provenance_stamp(spark, sf):
    adapter = adapters.OptionEodAdapter(AVAILABLE)
    rows = adapter.provenance(adapter.normalize(_udiff(spark, sf)))
    return rows.groupBy("source_id", "source_version", "diagnostic_only", "execution_backtest_allowed", F.date_format("available_at", "yyyy-MM-dd").alias("available")).agg(F.count("*").alias("n"))


@register("SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS at, value AS close, event_type AS instrument_id, strftime(ts, '%Y-%m-%d') AS session_id FROM events")
def ohlc_adapter(spark, sf):
    """Date and time in two columns, local to a zone east of Greenwich; one adapter per instrument."""
    e = V.table(spark, sf, "events")
    local = F.from_utc_timestamp(F.date_trunc("second", "ts").cast("timestamp"), "Asia/Kolkata")
    raw = e.select("event_type", F.date_format(local, "dd-MM-yyyy").alias("Date"), F.date_format(local, "HH:mm:ss").alias(" TIME"), *(F.col("value").cast("string").alias(n) for n in ("Open", "HIGH", "low", " Close ")), F.col("event_id").cast("string").alias("Volume"))
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of instruments
    parts = [adapters.OhlcAdapter(k, AVAILABLE, "Asia/Kolkata").normalize(raw.where(F.col("event_type") == k)) for k in kinds]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select(F.col("volume").cast("long").alias("event_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "close", "instrument_id", "session_id")


@register(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN t WHEN 1 THEN t - INTERVAL 330 MINUTE WHEN 2 THEN t - INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_custkey AS BIGINT) % 86400) AS t FROM orders)"""
)
def parsed_timestamps(spark, sf):
    """ISO with Z, ISO without a zone, day first, and text that is no time; the naive ones are local."""
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 86400)
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.date_format(t, "dd-MM-yyyy HH:mm:ss")).otherwise("no time")
    return V.table(spark, sf, "orders").select("o_orderkey", F.date_format(P.parse_timestamp(text, source_tz="Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@register(
    """SELECT local, CASE WHEN local BETWEEN '2024-03-10 02:00' AND '2024-03-10 02:59' OR local BETWEEN '2024-11-03 01:00' AND '2024-11-03 01:59' THEN NULL
  ELSE strftime(CAST(local AS TIMESTAMP) + CASE WHEN local >= '2024-03-10 03:00' AND local < '2024-11-03 01:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M') END AS utc
FROM (SELECT strftime(unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-01-01', INTERVAL 30 MINUTE)), '%Y-%m-%d %H:%M') AS local)"""
)
def local_times(spark, sf):
    """Half hours of a year in a zone with summer time: skipped and repeated ones are null."""
    every = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-12-31 23:30:00', INTERVAL 30 MINUTES)) AS t")
    return every.select(F.date_format("t", "yyyy-MM-dd HH:mm").alias("local"), F.date_format(P.local_to_utc(F.col("t"), "America/New_York"), "yyyy-MM-dd HH:mm").alias("utc"))


# --- sinks and the contract -------------------------------------------------------


@register("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def day_table(spark, sf):
    path = shared.fresh(spark, "by-day")
    sinks.write_by_day(V.table(spark, sf, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), "o_orderkey"), path, "day")
    return spark.read.schema("o_orderkey long, day string").parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@register(f'{_CHECK_SQL} SELECT "check", value, hard, hard AND value > 0 AS failed, true AS diagnostic_only FROM checks')
def report_file(spark, sf):
    path = shared.fresh(spark, "report") + ".json"
    sinks.write_report(_snapshot(spark, sf), path)
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("rows").alias("r"), "diagnostic_only").select("r.check", "r.value", "r.hard", "r.failed", "diagnostic_only")


@register("SELECT c_custkey, c_nationkey FROM customer")
def record_lines(spark, sf):
    path = shared.fresh(spark, "records")
    sinks.write_records(V.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), path)
    return spark.read.schema("c_custkey long, c_nationkey long").json(path)


@register(
    f"""SELECT * FROM (VALUES {", ".join(f"('{n}', '{','.join(layer.key)}', {len(layer.fields)}, {len(layer.required)})" for n, layer in schema.LAYERS.items())}) v(layer, key, fields, required)"""
)
def contract_layers(spark, sf):
    """The contract after its own check, as a table."""
    schema.check()
    rows = [(n, ",".join(layer.key), len(layer.schema.fields), sum(not f.nullable for f in layer.schema.fields)) for n, layer in schema.LAYERS.items()]
    return spark.createDataFrame(rows, "layer string, key string, fields int, required int")
