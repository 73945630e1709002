"""Reconciliation of archives: dates, routes, missing values, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.functions.parsing import route


def date_differences(left: DataFrame, right: DataFrame, day: str = "day") -> DataFrame:
    """Days of one side only: (day, side)."""
    a, b = left.select(day).distinct(), right.select(day).distinct()
    only = a.join(b, day, "left_anti").withColumn("side", F.lit("left_only"))
    return only.unionByName(b.join(a, day, "left_anti").withColumn("side", F.lit("right_only")))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def weekday_gaps(there: DataFrame, day: str = "day") -> DataFrame:
    """Mondays to Fridays between the first and the last day that are missing."""
    span = there.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias(day)).where(F.weekday(day) < 5)
    return every.join(there.select(day).distinct(), day, "left_anti")


def missing_by_route(panel: DataFrame, columns: list[str], cutover: str) -> DataFrame:
    """Rows and the percentage of nulls per column, by archive layout."""
    return panel.groupBy(route(F.col("trade_date"), cutover).alias("route")).agg(F.count("*").alias("n"), *((100 * F.avg(F.col(c).isNull().cast("int"))).alias(f"{c}_missing_pct") for c in columns))


def duplicate_years(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("year").agg(F.count("*").alias("n")).where("n > 1")


HARD = (
    "missing_year_manifests",
    "unexpected_year_manifests",
    "duplicate_contract_keys",
    "file_errors",
    "route_errors",
    "missing_normalized_dates",
    "unexpected_normalized_dates",
    "negative_price_rows",
    "expiry_before_trade",
    "nonpositive_strike",
)


def _tall(one: DataFrame, values: list[str], details: tuple[str, ...] = ()) -> DataFrame:
    """A one-row table as rows (check, value, detail)."""
    none = F.lit(None).cast("string")
    each = [F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), (F.col(f"{n}_of") if n in details else none).alias("detail")) for n in values]
    return one.select(F.explode(F.array(*each)).alias("t")).select("t.*")


def _listed(values: Column) -> Column:
    """Distinct values in order, comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(values.cast("string"))), ",")


def _histogram(rows: DataFrame, name: str, value: Column, missing: str) -> DataFrame:
    counts = rows.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("k")).agg(F.count("*").alias("n"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "n"))), ",")
    return counts.agg(F.count("*").cast("double").alias("value"), pairs.alias("detail")).select(F.lit(name).alias("check"), "value", "detail")


def historical_checks(panel: DataFrame, records: DataFrame, manifests: DataFrame, files: DataFrame, errors: DataFrame, years: list[int], cutover: str, first: str, last: str) -> DataFrame:
    """(check, value, detail, hard, failed) for a multi-year panel and its manifests.

    ``records`` (day, status, route, source_tier) are the manifests' days, ``manifests`` has a row
    per year, ``files`` and ``errors`` one per file read and per file that could not be.  Lists and
    histograms are their length, with the values in ``detail``; a share of an empty side is null.
    """
    neg = F.lit(False)
    for p in ("open", "high", "low", "close", "last_price", "settlement"):
        neg = neg | F.coalesce(F.col(p) < 0, F.lit(False))
    day, cut = F.col("trade_date"), F.lit(cutover).cast("date")
    sides = {"legacy": day < cut, "udiff": day >= cut}
    boundary = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)
    counts = {
        "normalized_rows": F.count("*"),
        "normalized_trade_dates": F.count_distinct("trade_date"),
        **{f"{s}_rows": F.count_if(c) for s, c in sides.items()},
        **{f"{s}_missing_{n}_pct": F.avg(F.when(c, F.col(f).isNull().cast("int"))) * 100 for n, f in (("last_price", "last_price"), ("underlying", "underlying_price"), ("lot_size", "lot_size")) for s, c in sides.items()},
        "zero_volume_rows": F.count_if(F.col("volume") == 0),
        "zero_open_interest_rows": F.count_if(F.col("open_interest") == 0),
        "ce_rows": F.count_if(F.col("option_type") == "CE"),
        "pe_rows": F.count_if(F.col("option_type") == "PE"),
        "unique_expiries": F.count_distinct("expiry"),
        "boundary_trade_dates": F.count_distinct(boundary),
        "negative_price_rows": F.count_if(neg),
        "expiry_before_trade": F.count_if(F.col("expiry") < day),
        "nonpositive_strike": F.count_if(F.col("strike") <= 0),
    }
    rows = _tall(panel.agg(*(e.alias(n) for n, e in counts.items()), _listed(boundary).alias("boundary_trade_dates_of")), list(counts), ("boundary_trade_dates",))
    keys = panel.groupBy("trade_date", "expiry", "strike", "option_type").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicate_contract_keys"))
    gone = F.when((F.col("status") == "NO_ARCHIVE") & (F.weekday("day") < 5), F.col("day"))
    of = records.agg(
        F.count("*").alias("manifest_records"),
        F.count_distinct(F.when(F.col("status") == "VALIDATED", F.col("day"))).alias("validated_days_from_manifests"),
        F.count_if(~F.col("route").eqNullSafe(route(F.col("day"), cutover))).alias("route_errors"),
        F.count(gone).alias("weekday_no_archive_count"),
        F.count_distinct(gone).alias("weekday_no_archive_days"),
        _listed(gone).alias("weekday_no_archive_days_of"),
    )
    validated = records.where("status = 'VALIDATED'").select("day")
    diff = date_differences(validated, panel.select(day.alias("day")).where("day IS NOT NULL"))
    apart = diff.agg(
        *(F.count_if(F.col("side") == s).alias(n) for n, s in (("missing_normalized_dates", "left_only"), ("unexpected_normalized_dates", "right_only"))),
        *(_listed(F.when(F.col("side") == s, F.col("day"))).alias(f"{n}_of") for n, s in (("missing_normalized_dates", "left_only"), ("unexpected_normalized_dates", "right_only"))),
    )
    expected = F.array(*map(F.lit, years)).cast("array<int>")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    found = manifests.agg(F.count("*").alias("manifest_count"), F.collect_set(F.col("year").cast("int")).alias("found"))
    found = found.withColumns({"absent": F.array_except(expected, "found"), "extra": F.array_except("found", expected)}).select(
        "manifest_count",
        *(c for n, a in (("expected_years", expected), ("years_found", F.col("found")), ("missing_year_manifests", F.col("absent")), ("unexpected_year_manifests", F.col("extra"))) for c in (F.size(a).alias(n), joined(a).alias(f"{n}_of"))),
    )
    lists = ("expected_years", "years_found", "missing_year_manifests", "unexpected_year_manifests")
    parts = [
        _tall(keys, ["duplicate_contract_keys"]),
        _tall(of, ["manifest_records", "validated_days_from_manifests", "route_errors", "weekday_no_archive_count", "weekday_no_archive_days"], ("weekday_no_archive_days",)),
        _tall(apart, ["missing_normalized_dates", "unexpected_normalized_dates"], ("missing_normalized_dates", "unexpected_normalized_dates")),
        _tall(found, ["manifest_count", *lists], lists),
        _tall(files.agg(F.count("*").alias("normalized_files")), ["normalized_files"]),
        _tall(errors.agg(F.count("*").alias("file_errors")), ["file_errors"]),
        _histogram(records, "status_counts", F.col("status"), "MISSING"),
        _histogram(records, "source_tiers", F.col("source_tier"), "missing"),
    ]
    for part in parts:
        rows = rows.unionByName(part)
    hard = F.col("check").isin(*HARD)
    return rows.select("check", "value", "detail", hard.alias("hard"), (hard & (F.coalesce("value", F.lit(0)) > 0)).alias("failed"))
