"""Volatility regimes: terciles of rolling deviation crossed with the direction of the return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.functions.series import ordered, rolling_std, whole
from strikeline.operators.diagnostics import KEY, returns


def labels(bars: DataFrame, window: int = 20) -> DataFrame:
    """Rows with a full window, labelled LOW/MID/HIGH_VOL x UP/DOWN/FLAT; instruments without spread give none."""
    if window < 5:
        raise ValueError("window must be at least 5")
    r = returns(bars).where("log_ret IS NOT NULL").withColumn("vol", rolling_std("log_ret", window, ordered())).where("vol IS NOT NULL")
    cut = {"q1": F.percentile("vol", F.lit(1.0) / 3), "q2": F.percentile("vol", F.lit(2.0) / 3), "usable": F.count("*")}
    r = r.withColumns({name: e.over(whole()) for name, e in cut.items()}).where("q1 < q2 AND usable >= 10")
    level = F.when(F.col("vol") <= F.col("q1"), "LOW_VOL").when(F.col("vol") <= F.col("q2"), "MID_VOL").otherwise("HIGH_VOL")
    way = F.when(F.col("log_ret") > 0, "UP").when(F.col("log_ret") < 0, "DOWN").otherwise("FLAT")
    return r.select(KEY, "ts", "log_ret", "vol", F.concat_ws("_", level, way).alias("regime"))


def stats(labelled: DataFrame) -> DataFrame:
    """Count, share and means per label; the share's total is a window over the few aggregated rows."""
    g = labelled.groupBy(KEY, "regime").agg(F.count("*").alias("n"), F.avg("log_ret").alias("mean_return"), F.avg(F.abs("log_ret")).alias("mean_abs_return"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(whole()))


def transitions(labelled: DataFrame) -> DataFrame:
    """How often one label follows another."""
    pairs = labelled.withColumn("to", F.lead("regime").over(ordered())).where("to IS NOT NULL")
    return pairs.groupBy(KEY, F.col("regime").alias("from_regime"), F.col("to").alias("to_regime")).agg(F.count("*").alias("n"))


def runs(labelled: DataFrame) -> DataFrame:
    """Runs of equal labels: how many, mean and greatest length."""
    w = ordered()
    change = labelled.withColumn("new", F.when(F.lag("regime").over(w).eqNullSafe(F.col("regime")), 0).otherwise(1))
    island = change.withColumn("run", F.sum("new").over(w))
    each = island.groupBy(KEY, "regime", "run").agg(F.count("*").alias("length"))
    return each.groupBy(KEY, "regime").agg(F.count("*").alias("runs"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"))
