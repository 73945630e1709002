"""Descriptive diagnostics of bar series, one result per instrument (or per instrument and lag)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions.series import adjusted_kurtosis, adjusted_skewness, drawdown, log_return, ordered, rolling_std, safe_corr, simple_return, whole

KEY = "instrument_id"


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def returns(bars: DataFrame) -> DataFrame:
    """Simple and log returns of the closes."""
    w = ordered()
    return bars.select(KEY, "ts", "close", simple_return("close", w).alias("ret"), log_return("close", w).alias("log_ret"))


def stylized_facts(bars: DataFrame) -> DataFrame:
    """Moments of returns, correlation of neighbouring absolute returns, and the deepest drawdown."""
    w = ordered()
    r = returns(bars).withColumn("dd", drawdown("close", w)).withColumn("a", F.abs("ret"))
    r = r.withColumns({"a1": F.lag("a", 1).over(w), "a5": F.lag("a", 5).over(w)})
    n = F.count("ret")
    return r.groupBy(KEY).agg(
        F.count("*").alias("n_rows"),
        n.alias("n_returns"),
        F.avg("ret").alias("mean_return"),
        F.stddev_samp("ret").alias("sd_return"),
        adjusted_skewness("ret").alias("skewness"),
        adjusted_kurtosis("ret").alias("excess_kurtosis"),
        F.stddev_samp("log_ret").alias("sd_log_return"),
        F.when(n > 3, safe_corr("a", "a1")).alias("abs_autocorr_1"),
        F.when(n > 7, safe_corr("a", "a5")).alias("abs_autocorr_5"),
        F.min("dd").alias("max_drawdown"),
    )


def realized_volatility(bars: DataFrame, periods: float = 252.0) -> DataFrame:
    """Close-to-close, Parkinson, Garman-Klass and Yang-Zhang volatility, annualized; rows with a previous close."""
    _check(periods > 0, "periods must be positive")
    w, ln2 = ordered(), math.log(2)
    x = bars.withColumn("pc", F.lag("close").over(w)).where("pc IS NOT NULL")
    x = x.select(
        KEY,
        F.ln(F.col("open") / F.col("pc")).alias("o"),
        F.ln(F.col("close") / F.col("open")).alias("c"),
        F.ln(F.col("high") / F.col("low")).alias("hl"),
        (F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open")) + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open"))).alias("rs"),
    )
    v = x.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.var_samp(F.col("o") + F.col("c")).alias("cc"),
        (F.avg(F.col("hl") * F.col("hl")) / (4 * ln2)).alias("pk"),
        F.avg(0.5 * F.col("hl") * F.col("hl") - (2 * ln2 - 1) * F.col("c") * F.col("c")).alias("gk"),
        F.var_samp("o").alias("vo"),
        F.var_samp("c").alias("vc"),
        F.avg("rs").alias("rs"),
    )
    k = 0.34 / (1.34 + F.try_divide(F.col("n") + 1.0, F.col("n") - 1.0))
    yearly = lambda e: F.sqrt(F.greatest(e, F.lit(0.0)) * periods)
    return v.select(
        KEY,
        F.col("n").alias("n_periods"),
        yearly(F.col("cc")).alias("close_to_close"),
        yearly(F.col("pk")).alias("parkinson"),
        yearly(F.col("gk")).alias("garman_klass"),
        yearly(F.col("vo") + k * F.col("vc") + (1 - k) * F.col("rs")).alias("yang_zhang"),
    )


def acf(bars: DataFrame, lags: int = 10) -> DataFrame:
    """Autocorrelation around the global mean, by series and lag, with the band 1.96 / sqrt(n).

    The series are log returns, their absolute values and squares.  Means and leads are windows
    over the partitioning of the returns, and every lag is one sum: the input is read and
    shuffled once, and rows are never multiplied.
    """
    _check(lags >= 1, "lags must be at least 1")
    x = F.col("log_ret")
    forms = {"ret": x, "abs": F.abs(x), "sq": x * x}
    r = returns(bars).where("log_ret IS NOT NULL")
    d = r.select(KEY, "ts", *((e - F.avg(e).over(whole())).alias(name) for name, e in forms.items()))
    steps = [(name, k) for name in forms for k in range(1, lags + 1)]
    products = d.select("*", *((F.col(name) * F.lead(name, k).over(ordered())).alias(f"{name}{k}") for name, k in steps))
    sums = products.groupBy(KEY).agg(F.count("*").alias("n"), *(F.sum(F.col(name) * F.col(name)).alias(name) for name in forms), *(F.sum(f"{name}{k}").alias(f"{name}{k}") for name, k in steps))
    tall = F.explode(F.array(*(F.struct(F.lit(name).alias("series"), F.lit(k).alias("lag"), F.col(name).alias("den"), F.col(f"{name}{k}").alias("top")) for name, k in steps)))
    by = sums.select(KEY, "n", tall.alias("s")).select(KEY, "n", "s.*")
    return by.select(KEY, "series", "lag", F.when((F.col("n") > F.col("lag") + 1) & (F.col("den") > 0), F.try_divide("top", "den")).alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def pacf(bars: DataFrame, lags: int = 5) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson on at most ``lags`` numbers per series, as chained columns."""
    a = acf(bars, lags).where("series != 'sq'").groupBy(KEY, "series").pivot("lag", list(range(1, lags + 1))).agg(F.first("acf"))
    a = a.select(KEY, "series", *(F.col(str(k)).alias(f"r{k}") for k in range(1, lags + 1)))
    a = a.withColumns({"p1_1": F.col("r1"), "v1": 1 - F.col("r1") * F.col("r1")})
    for k in range(2, lags + 1):
        top = F.col(f"r{k}") - sum((F.col(f"p{k - 1}_{j}") * F.col(f"r{k - j}") for j in range(1, k)), F.lit(0.0))
        a = a.withColumn(f"p{k}_{k}", F.when(F.col(f"v{k - 1}") > 1e-12, F.try_divide(top, F.col(f"v{k - 1}"))))
        a = a.withColumns({f"p{k}_{j}": F.col(f"p{k - 1}_{j}") - F.col(f"p{k}_{k}") * F.col(f"p{k - 1}_{k - j}") for j in range(1, k)})
        a = a.withColumn(f"v{k}", F.col(f"v{k - 1}") * (1 - F.col(f"p{k}_{k}") * F.col(f"p{k}_{k}")))
    tall = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"p{k}_{k}").alias("pacf")) for k in range(1, lags + 1))))
    return a.select(KEY, "series", tall.alias("t")).select(KEY, "series", "t.*")


def rolling_vol(bars: DataFrame, window: int = 20) -> DataFrame:
    """Deviation of the last ``window`` log returns, full windows only."""
    _check(window >= 2, "window must be at least 2")
    r = returns(bars).where("log_ret IS NOT NULL")
    return r.withColumn("vol", rolling_std("log_ret", window, ordered())).where("vol IS NOT NULL").select(KEY, "ts", "vol")


def rolling_vol_summary(bars: DataFrame, window: int = 20) -> DataFrame:
    return rolling_vol(bars, window).groupBy(KEY).agg(F.count("*").alias("n"), F.avg("vol").alias("mean_vol"), F.median("vol").alias("median_vol"), F.min("vol").alias("min_vol"), F.max("vol").alias("max_vol"))


def _scored(bars: DataFrame, z: float) -> DataFrame:
    """Every bar with its place, log return, robust z-score and flag; all windows share one partitioning."""
    _check(z > 0, "z must be positive")
    x = F.col("log_ret")
    r = bars.withColumn("source_row", F.row_number().over(ordered()) - 1).withColumn("log_ret", log_return("close", ordered()))
    r = r.withColumns({"med": F.median(x).over(whole()), "mean": F.avg(x).over(whole()), "sd": F.stddev_samp(x).over(whole())})
    r = r.withColumn("mad", F.median(F.abs(x - F.col("med"))).over(whole()))
    score = F.when(F.col("mad") > 0, (x - F.col("med")) / (1.4826 * F.col("mad"))).when(F.col("sd") > 0, (x - F.col("mean")) / F.col("sd"))
    return r.withColumn("z", score).withColumn("is_jump", F.coalesce(F.abs("z") > z, F.lit(False)))


def jump_scores(bars: DataFrame, z: float = 3.0) -> DataFrame:
    """Robust z-scores of log returns (median and MAD; mean and deviation if MAD is 0) and their flags."""
    return _scored(bars, z).where("log_ret IS NOT NULL").select(KEY, "ts", "source_row", "log_ret", "z", "is_jump")


def jump_summary(bars: DataFrame, z: float = 3.0) -> DataFrame:
    """Flag counts, realized and bipower variation, and the range proxy (a per-row mean over all rows)."""
    past = ordered().rowsBetween(Window.unboundedPreceding, -1)
    s = _scored(bars, z).withColumn("before", F.abs(F.last("log_ret", ignorenulls=True).over(past)))
    hl = F.ln(F.col("high") / F.col("low"))
    v = s.groupBy(KEY).agg(
        F.count("log_ret").alias("n_returns"),
        F.count_if("is_jump").alias("n_jumps"),
        F.array_sort(F.collect_list(F.when(F.col("is_jump"), F.col("source_row")))).alias("rows"),
        F.sum(F.col("log_ret") * F.col("log_ret")).alias("realized_variance"),
        (math.pi / 2 * F.coalesce(F.sum(F.abs("log_ret") * F.col("before")), F.lit(0.0))).alias("bipower_variation"),
        (F.avg(hl * hl) / (4 * math.log(2))).alias("parkinson_mean"),
    )
    floor = lambda e: F.greatest(e, F.lit(0.0))
    return v.where("n_returns > 0").select(
        KEY,
        "n_returns",
        "n_jumps",
        F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("jump_rows"),
        "realized_variance",
        "bipower_variation",
        floor(F.col("realized_variance") - F.col("bipower_variation")).alias("excess_variation"),
        floor(F.col("realized_variance") - F.col("parkinson_mean")).alias("range_excess"),
    )
