"""Sinks: partitioned tables, envelopes, one-row reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.sources.shared import write_text


def write_by_day(rows: DataFrame, path: str, day: str = "trade_date", fmt: str = "parquet") -> None:
    """One folder per day; rows of a day meet first, so that a day is few files (and a large one is split)."""
    rows.hint("rebalance", day).write.partitionBy(day).mode("overwrite").format(fmt).option("header", True).save(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in parallel."""
    rows.write.mode("overwrite").json(path)


def report_json(rows: DataFrame, limit: int = 10_000) -> list[dict]:
    """A report (few rows by its nature) as Python values; refuses anything larger."""
    found = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError("not a report: write it as a table")
    return [json.loads(r.j) for r in found]


def write_report(rows: DataFrame, path: str, sort_keys: bool = True) -> None:
    """An indented JSON file for people, stamped as diagnostic."""
    report = {"diagnostic_only": True, "execution_backtest_allowed": False, "rows": report_json(rows)}
    write_text(rows.sparkSession, path, json.dumps(report, indent=2, sort_keys=sort_keys) + "\n")
