"""Expressions over ordered series.  Every window is partitioned by the series' key."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str = "instrument_id", by: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(by)


def whole(key: str = "instrument_id") -> WindowSpec:
    """All rows of a series: shares the partitioning of :func:`ordered`, so no further shuffle."""
    return Window.partitionBy(key)


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def simple_return(x: str, w: WindowSpec) -> Column:
    return F.try_divide(c(x), F.lag(c(x)).over(w)) - 1


def log_return(x: str, w: WindowSpec) -> Column:
    return F.ln(c(x)) - F.ln(F.lag(c(x)).over(w))


def rolling_std(x: str | Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation over the last n values; null until n values are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c(x)).over(frame) == n, F.stddev_samp(c(x)).over(frame))


def drawdown(x: str, w: WindowSpec) -> Column:
    return c(x) / F.max(c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def adjusted_skewness(x: str | Column) -> Column:
    """Bias-adjusted sample skewness, null for fewer than three values."""
    n = F.count(c(x)).cast("double")
    return F.when((n > 2) & (F.var_pop(c(x)) > 0), F.skewness(c(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: str | Column) -> Column:
    """Bias-adjusted excess kurtosis, null for fewer than four values."""
    n = F.count(c(x)).cast("double")
    return F.when((n > 3) & (F.var_pop(c(x)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c(x)) + 6))


def safe_corr(x: str | Column, y: str | Column, least: int = 2) -> Column:
    """Pearson correlation of complete pairs; null for a constant side or fewer than ``least`` pairs."""
    both = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(both, c(x)), F.when(both, c(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= least, F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-300, spread)))


def average_rank(x: str, key: str) -> Column:
    """Rank with ties averaged, within ``key``."""
    return F.rank().over(Window.partitionBy(key).orderBy(x)) + (F.count("*").over(Window.partitionBy(key, x)) - 1) / F.lit(2.0)
