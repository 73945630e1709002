"""Evaluation of strategies: chronological folds with purge and embargo, path metrics, costs, trial statistics."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions.series import adjusted_kurtosis, adjusted_skewness, drawdown


def chronological_folds(samples: DataFrame, folds: int, at: str = "ts") -> DataFrame:
    """Equal parts of the time axis between the first and the last sample: ``fold`` 0 .. folds-1.

    Cutting the axis and not the ranks needs no global sort.
    """
    t = F.col(at).cast("timestamp").cast("double")
    span = samples.agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    part = F.least(F.floor(F.try_divide(t - F.col("__a"), F.col("__b") - F.col("__a")) * folds), F.lit(folds - 1))
    return samples.crossJoin(F.broadcast(span)).withColumn("fold", F.coalesce(part, F.lit(0)).cast("int")).drop("__a", "__b")


def purged_training(samples: DataFrame, folds: int, label_end: str = "label_end", at: str = "ts", embargo_seconds: int = 0) -> DataFrame:
    """(sample, test_fold): training rows whose label interval meets neither the test span nor its embargo."""
    x = chronological_folds(samples, folds, at)
    span = x.groupBy(F.col("fold").alias("test_fold")).agg(F.min(at).alias("__from"), F.max(label_end).alias("__to"))
    limit = F.col("__to") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(embargo_seconds)))
    meets = (F.col(at) <= limit) & (F.col(label_end) >= F.col("__from"))
    # one row per fold on the broadcast side
    return x.join(F.broadcast(span), (F.col("fold") != F.col("test_fold")) & ~meets).drop("__from", "__to")


def combinatorial_folds(folds: int, held: int) -> list[tuple[int, ...]]:
    """All choices of ``held`` test folds."""
    return list(combinations(range(folds), held))


def path_metrics(returns: DataFrame, key: str = "instrument_id", periods: float = 252.0, x: str = "ret") -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, drawdown, 5 % tail loss."""
    r = returns.where(F.col(x).isNotNull() & (F.col(x) > -1)).select(key, "ts", F.col(x).alias("r"))
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    wealth = r.withColumn("wealth", F.exp(F.sum(F.ln(1 + F.col("r"))).over(w)))
    wealth = wealth.withColumn("dd", F.least(drawdown("wealth", Window.partitionBy(key).orderBy("ts")), F.col("wealth") - 1))
    low = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), F.lit(2.0))))
    a = wealth.groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), low.alias("d"), F.avg(F.ln(1 + F.col("r"))).alias("g"), F.min("dd").alias("max_drawdown"), F.percentile("r", 0.05).alias("tail_5"))
    root = math.sqrt(periods)
    return a.select(key, "n", (F.col("m") * periods).alias("annual_return"), (F.col("s") * root).alias("annual_vol"), (F.try_divide("m", "s") * root).alias("sharpe"), (F.try_divide("m", "d") * root).alias("sortino"), F.col("g").alias("mean_log_growth"), "max_drawdown", "tail_5")


def deflated_sharpe(returns: DataFrame, key: str = "instrument_id", x: str = "ret") -> DataFrame:
    """Per trial: Sharpe per period, the largest one expected by chance among all trials, and the z of the difference.

    The trials' Sharpe ratios are a few numbers per trial, aggregated; the
    normal distribution is left to the reader (``z`` is its argument).
    """
    a = returns.where(F.col(x).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("sharpe"), adjusted_skewness(x).alias("skew"), adjusted_kurtosis(x).alias("kurt"))
    t = a.agg(F.count("sharpe").alias("trials"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("spread"))
    top = F.col("spread") * F.sqrt(2 * F.ln(F.greatest(F.col("trials"), F.lit(2))))
    z = (F.col("sharpe") - F.col("expected_max")) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") + 2) / 4 * F.col("sharpe") * F.col("sharpe"), F.lit(1e-12)))
    return a.crossJoin(F.broadcast(t)).withColumn("expected_max", top).select(key, "n", "sharpe", "expected_max", z.alias("z"))


def net_of_costs(trades: DataFrame, rate: float, fixed: float) -> DataFrame:
    """Proportional and fixed costs of trades (gross, notional)."""
    cost = F.abs("notional") * rate + fixed
    return trades.withColumns({"cost": cost, "net": F.col("gross") - cost})


def variance_premium(implied: DataFrame, realized: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Implied minus later realized variance per row (joined on key and ts): moments, quartiles, share above zero."""
    x = implied.join(realized, [key, "ts"]).withColumn("vrp", F.col("implied_var") - F.col("realized_var")).where("vrp IS NOT NULL")
    return x.groupBy(key).agg(F.count("*").alias("n"), F.avg("vrp").alias("mean_vrp"), F.median("vrp").alias("median_vrp"), F.percentile("vrp", 0.25).alias("q25"), F.percentile("vrp", 0.75).alias("q75"), F.avg((F.col("vrp") > 0).cast("int")).alias("positive_share"))
