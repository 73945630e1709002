"""Adapters, scans, archives, manifests and sinks on small files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strikeline import schema
from strikeline.functions import parsing
from strikeline.operators import pit, quality
from strikeline.sources import adapters, archive, files, sinks

OPTIONS = """Symbol,Trade Date,Expiry,Option Type,Strike Price,Open,High,Low,Close,Settle Price,No. of contracts,Open Int,Underlying Value
ORCHID,14-Mar-2023,30-Mar-2023,CE,"7,400",41.5,44.25,40.0,43.0,43.5,310,8150,7391.5
ORCHID,14-Mar-2023,30-Mar-2023,PE,7400.5,37.0,39.5,36.25,38.0,-,275,6900,7391.5
OTHER,6-3-2023,2023-03-30,,0,1,1,1,1,1,1,1,N/A
"""
MINUTES = "﻿Date,TIME,open,high,low,close,volume\n2023-03-14,09:15:00,7391.5,7396,7388,7394,\n2023-03-14,09:16:00,7394,7402,7389,7400,null\n"
MASTER = """contract_id,lot_size,effective_from,effective_to,available_at
ORCHID|2023-03-30|CE|7400,65,2023-03-01T00:00:00Z,2023-03-30T23:59:59Z,2023-03-14T16:00:00Z
ORCHID|2023-03-30|PE|7400.5,65,2023-03-01T00:00:00Z,,2023-03-14T16:00:00Z
ORCHID|2023-03-30|PE|7400.5,50,2023-03-08T00:00:00Z,,2023-03-14T16:00:00Z
"""


def written(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def options(spark, tmp_path, **more):
    return adapters.OptionEodAdapter("2023-03-14T15:00:00Z", **more).normalize(files.read_csv(spark, written(tmp_path, "o.csv", OPTIONS)))


def test_option_adapter(spark, tmp_path):
    rows = options(spark, tmp_path, symbol="orchid").orderBy("option_type").collect()
    assert [r.instrument_id for r in rows] == ["ORCHID|2023-03-30|CE|7400", "ORCHID|2023-03-30|PE|7400.5"]
    assert [r.option_type for r in rows] == ["CE", "PE"] and rows[0].strike == 7400.0 and rows[1].settlement is None
    assert rows[0].timestamp == dt.datetime(2023, 3, 14) and rows[0].lot_size is None and rows[0].last_price_source is None
    whole = options(spark, tmp_path)
    other = whole.where("underlying_id = 'OTHER'").first()
    assert (other.timestamp, other.instrument_class, other.underlying_price) == (dt.datetime(2023, 3, 6), "future_or_other", None)
    assert adapters.OptionEodAdapter.enrichment(whole).first()[0] is True
    assert adapters.Adapter().validate(whole).count() == 0


def test_archive_layouts_share_the_adapter(spark, tmp_path):
    head = "TIMESTAMP,INSTRUMENT,SYMBOL,EXPIRY_DT,STRIKE_PR,OPTION_TYP,OPEN,HIGH,LOW,CLOSE,SETTLE_PR,CONTRACTS,VAL_INLAKH,OPEN_INT,CHG_IN_OI,LAST\n"
    old = files.read_csv(spark, written(tmp_path, "l.csv", head + "13-APR-2020,OPTIDX,ORCHID,30-Apr-2020,9000,CE,1,2,1,2,2,3,1.5,4,5,7\n"))
    r = adapters.OptionEodAdapter("2020-04-13T18:00:00Z").normalize(old).first()
    assert (r.turnover, r.last_price, r.last_price_source, r.change_in_oi) == (150000.0, 7.0, "LAST", 5.0)
    with pytest.raises(ValueError, match="strike"):
        adapters.OptionEodAdapter("2020-04-13T18:00:00Z").normalize(old.drop("STRIKE_PR"))
    with pytest.raises(ValueError, match="explicit Z"):
        adapters.OptionEodAdapter("2020-04-13T18:00:00")


def test_ohlc_adapter(spark, tmp_path):
    raw = files.read_csv(spark, written(tmp_path, "m.csv", MINUTES))
    rows = adapters.OhlcAdapter("IDX", "2023-03-14T16:00:00Z").normalize(raw).orderBy("timestamp").collect()
    assert rows[0].timestamp == dt.datetime(2023, 3, 14, 9, 15) and rows[0].volume is None and rows[1].volume is None
    local = adapters.OhlcAdapter("IDX", "2023-03-14T16:00:00Z", "Asia/Kolkata").normalize(raw).orderBy("timestamp").first()
    assert local.timestamp == dt.datetime(2023, 3, 14, 3, 45)


def test_numbers_and_times(spark):
    x = spark.createDataFrame([(" 1,234.5 ", "2023-03-14T09:15:00+05:30"), ("N/A", "2023-03-14T09:15:00Z"), ("-", "14-03-2023"), (None, None)], "n string, t string")
    rows = x.select(parsing.parse_number(F.col("n")).alias("n"), parsing.parse_timestamp(F.col("t")).alias("t")).collect()
    assert [r.n for r in rows] == [1234.5, None, None, None]
    assert [r.t for r in rows] == [dt.datetime(2023, 3, 14, 3, 45), dt.datetime(2023, 3, 14, 9, 15), dt.datetime(2023, 3, 14), None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x1",)], "n string").select(parsing.parse_number(F.col("n"))).collect()
    assert spark.createDataFrame([("x1",)], "n string").select(parsing.coerce_number(F.col("n"))).first()[0] is None


def test_enrichment(spark, tmp_path):
    rows = options(spark, tmp_path).withColumn("record_index", F.monotonically_increasing_id()).withColumnRenamed("instrument_id", "contract_id")
    master = files.read_csv(spark, written(tmp_path, "c.csv", MASTER)).select("contract_id", F.col("lot_size").cast("double").alias("master_lot"), *(F.col(c).cast("timestamp").alias(c) for c in ("effective_from", "effective_to", "available_at")))
    late, early = (F.lit(t).cast("timestamp") for t in ("2023-03-14T17:00:00Z", "2023-03-14T15:00:00Z"))
    found = {r.contract_id: (r.match_status, r.master_lot) for r in pit.match_master(rows, master, late, at="timestamp").collect()}
    assert found["ORCHID|2023-03-30|CE|7400"] == ("ENRICHED", 65.0)
    assert found["ORCHID|2023-03-30|PE|7400.5"] == ("CONTRACT_MASTER_AMBIGUOUS", None)
    assert {s for s, _ in found.values()} == {"ENRICHED", "CONTRACT_MASTER_AMBIGUOUS", "CONTRACT_MASTER_NOT_FOUND"}
    assert {r.match_status for r in pit.match_master(rows, master, early, at="timestamp").collect()} == {"CONTRACT_MASTER_NOT_FOUND"}


GOOD = {"timestamp": "2026-01-01T00:00:00Z", "available_at": "2026-01-01T12:00:00Z", "instrument_id": "a", "underlying_id": "u", "expiry": "2026-02-01T00:00:00Z", "strike": "10", "open": "2", "high": "3", "low": "1", "close": "2", "volume": "5", "open_interest": "6", "option_type": "CE"}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []),
        ({"close": ""}, ["MISSING_REQUIRED_FIELD"]),
        ({"expiry": "soon", "strike": "-1"}, ["INVALID_TIMESTAMP"]),
        ({"available_at": "2025-12-31T00:00:00Z"}, ["AVAILABLE_BEFORE_OBSERVATION"]),
        ({"available_at": "2027-01-01T00:00:00Z"}, ["LOOKAHEAD_AVAILABLE_AFTER_DECISION"]),
        ({"expiry": "2025-01-01T00:00:00Z"}, ["EXPIRY_BEFORE_OBSERVATION"]),
        ({"strike": "x"}, ["NON_NUMERIC_VALUE"]),
        ({"volume": "-1"}, ["NEGATIVE_ACTIVITY", "NEGATIVE_VALUE"]),
        ({"strike": "0"}, ["NON_POSITIVE_STRIKE"]),
        ({"high": "0.5"}, ["INVALID_OHLC_RANGE"]),
        ({"option_type": None}, ["INVALID_OPTION_TYPE"]),
        ({"open": "NaN"}, ["NON_NUMERIC_VALUE"]),
    ],
)
def test_reasons(spark, change, codes):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values()) + (0,)], ", ".join(f"{k} string" for k in row) + ", at int")
    judged = quality.reasons(df, F.lit("2026-06-01T00:00:00Z").cast("timestamp"), ["at"])
    assert judged.first().reasons == codes


def test_duplicate_reason_reaches_stopped_rows(spark):
    df = spark.createDataFrame([(*GOOD.values(), 0), (*{**GOOD, "close": None}.values(), 1)], ", ".join(f"{k} string" for k in GOOD) + ", at int")
    judged = quality.reasons(df, F.lit("2026-06-01T00:00:00Z").cast("timestamp"), ["at"])
    assert [r.reasons for r in judged.orderBy("at").collect()] == [[], ["DUPLICATE_CANONICAL_KEY", "MISSING_REQUIRED_FIELD"]]
    assert quality.report(judged).first().status == "REJECT_ROWS"


def test_union_of_files(spark, tmp_path):
    written(tmp_path, "a.csv", "x,y\n1,2\n")
    written(tmp_path, "b.csv", "y,x,z\n4,3,5\n")
    written(tmp_path, "c.csv", "y\n9\n")
    rows, bad = files.read_csv_union(spark, str(tmp_path), ("x", "y"))
    assert sorted((r.x, r.y, r._source_file) for r in rows.collect()) == [("1", "2", "a.csv"), ("3", "4", "b.csv")]
    assert [r.error for r in bad.collect()] == ["missing required columns: ['x']"]


def test_envelope_manifest_and_probe(spark, tmp_path):
    path = written(tmp_path, "e.json", json.dumps({"dataset_id": "d", "source": "S 1", "records": [{"a": 1}, {"a": None}]}))
    csv = written(tmp_path, "e.csv", "p,q\r\n1,2\r\n")
    head, rows = files.read_envelope(spark, path)
    assert head.first().dataset_id == "d" and rows.count() == 2
    found = {r.path.rsplit("/", 1)[1]: r for r in archive.snapshot_manifest(spark, str(tmp_path), "s", "1", "c").collect()}
    assert found["e.json"].row_count == 2 and found["e.csv"].row_count is None
    assert set(schema.MANIFEST_FIELDS) <= set(found["e.csv"].asDict())
    assert files.probe(spark, csv).first().first_line == "p,q"
    told = files.probe_json(spark, path).first()
    assert (told.kind, told.row_count, len(told.sample)) == ("dict", 2, 2)


def test_daily_archive(spark, tmp_path):
    primary, mirror = tmp_path / "p", tmp_path / "m"
    primary.mkdir()
    mirror.mkdir()
    for folder, day in ((primary, dt.date(2024, 7, 5)), (mirror, dt.date(2024, 7, 8))):
        (folder / archive.file_name(day)).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(folder / archive.file_name(day), "w") as z:
            z.writestr("read.me", "x")
            z.writestr("a.csv", "TradDt,TckrSymb\n2024-07-08,N\n")
    (primary / "content/historical/DERIVATIVES/2024/JUL/bad.csv.zip").write_bytes(b"junk")
    spark.dataSource.register(archive.ArchiveSource)
    days = spark.read.format("daily_archive").option("start", "2024-07-05").option("end", "2024-07-08").option("tiers", f"{primary},{mirror}").load()
    rows = {str(r.day): r for r in days.collect()}
    assert [rows[d].status for d in sorted(rows)] == ["VALIDATED", "NO_ARCHIVE", "NO_ARCHIVE", "VALIDATED"]
    assert (rows["2024-07-05"].route, rows["2024-07-08"].route, rows["2024-07-08"].source_tier) == ("legacy", "udiff", 1)
    m = archive.acquisition_manifest(days).first()
    assert (m.validated, m.no_archive, m.errors, m.failed) == (2, 2, 0, False)
    cells = files.read_zipped_csv(spark, f"{primary}/content/*/*/*/*").collect()
    assert {(c.error is None, c.fields.get("TckrSymb")) for c in cells} == {(True, "N"), (False, None)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", None)], "trade_date string, v int")
    sinks.write_by_day(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and (tmp_path / "t/trade_date=2024-01-01").exists()
    sinks.write_report(rows, str(tmp_path / "r/report.json"))
    told = json.loads((tmp_path / "r/report.json").read_text())
    assert told["execution_backtest_allowed"] is False and told["rows"][1] == {"trade_date": "2024-01-02", "v": None}
    with pytest.raises(ValueError, match="table"):
        sinks.report_json(rows, 1)


def test_contract():
    schema.check()
    assert set(schema.LAYERS) == {"underlying_eod", "option_eod", "contract_master", "india_vix", "risk_free", "intraday_quotes_trades"}
    broken = schema.Layer((("timestamp", "ts"),), ("timestamp",))
    with pytest.raises(ValueError, match="available_at"):
        schema.check({"x": broken})
