"""Joint study of an underlying and a volatility index: aligned rows, terciles, conditional means, correlations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions.series import average_rank, rolling_std, safe_corr

PAIRS = (("ret", "vix_close"), ("abs_ret", "vix_close"), ("vix_change", "next_abs_ret"))


def align(underlying: DataFrame, index: DataFrame, window: int = 20) -> DataFrame:
    """Inner join on ts; return, range and volatility from the underlying's own rows, change and lead from the joined ones."""
    w = Window.partitionBy("instrument_id").orderBy("ts")
    u = underlying.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
    u = u.withColumn("range_pct", F.try_divide(F.col("high") - F.col("low"), F.col("open"))).withColumn("vol20", rolling_std("ret", window, w) * math.sqrt(252))
    x = u.join(index.select("ts", F.col("close").alias("vix_close")), "ts")
    x = x.withColumns({"abs_ret": F.abs("ret"), "vix_change": F.try_divide("vix_close", F.lag("vix_close").over(w)) - 1})
    x = x.withColumns({"next_ret": F.lead("ret").over(w), "next_abs_ret": F.lead("abs_ret").over(w)})
    return x.select("instrument_id", "ts", "ret", "abs_ret", "range_pct", "vol20", "vix_close", "vix_change", "next_ret", "next_abs_ret")


def terciles(aligned: DataFrame) -> DataFrame:
    """Equal-frequency thirds of the index by rank, ties in order of time."""
    rows = aligned.where("vix_close IS NOT NULL")
    rn = F.row_number().over(Window.partitionBy("instrument_id").orderBy("vix_close", "ts"))
    n = F.count("*").over(Window.partitionBy("instrument_id"))
    rows = rows.withColumns({"rn": rn, "n": n})
    return rows.withColumn("tercile", F.when(F.expr("rn <= (n + 1) div 3"), "LOW").when(F.expr("rn <= (2 * n) div 3"), "MID").otherwise("HIGH")).drop("rn", "n")


def conditional_means(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("instrument_id", "tercile").agg(
        F.count("*").alias("n"),
        F.avg("abs_ret").alias("mean_abs_ret"),
        F.avg("range_pct").alias("mean_range_pct"),
        F.avg("vol20").alias("mean_vol20"),
        F.avg("next_abs_ret").alias("mean_next_abs_ret"),
    )


def correlations(aligned: DataFrame, least: int = 20) -> DataFrame:
    """Pearson and Spearman correlation of each pair of columns, from complete pairs; null below ``least`` pairs."""
    tall = F.explode(F.array(*(F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in PAIRS)))
    p = aligned.select("instrument_id", tall.alias("p")).select(F.concat_ws("|", "instrument_id", "p.pair").alias("key"), "instrument_id", "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumns({"rx": average_rank("x", "key"), "ry": average_rank("y", "key")})
    return p.groupBy("instrument_id", "pair").agg(F.count("*").alias("n"), safe_corr("x", "y", least).alias("pearson"), safe_corr("rx", "ry", least).alias("spearman"))
