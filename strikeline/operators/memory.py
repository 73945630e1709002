"""Long memory: detrended fluctuation analysis, its multifractal form, bootstrap and surrogate.

Fits of every order are plain aggregations over (scale, segment).  Series stay
apart by ``instrument_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "instrument_id"
SCALES = (8, 12, 16, 24, 32, 48, 64)
ORDERS_Q = (-2, -1, 0, 1, 2)
LEAST_RETURNS = 96


def _numbered(returns: DataFrame) -> DataFrame:
    """(instrument, i, x, n): the non-null log returns in order, from 0."""
    r = returns.where("log_ret IS NOT NULL").select(KEY, "ts", F.col("log_ret").alias("x"))
    r = r.withColumn("i", F.row_number().over(Window.partitionBy(KEY).orderBy("ts")) - 1)
    return r.select(KEY, "i", "x", F.count("*").over(Window.partitionBy(KEY)).alias("n"))


def profile(numbered: DataFrame) -> DataFrame:
    """Running sum of demeaned returns."""
    mean = F.avg("x").over(Window.partitionBy(KEY))
    w = Window.partitionBy(KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("mean", mean).withColumn("y", F.sum(F.col("x") - F.col("mean")).over(w)).select(KEY, "i", "n", "y")


def segments(prof: DataFrame) -> DataFrame:
    """The profile once per scale and direction, cut into segments; k is the place inside a segment.

    Scales above a quarter of the series are left out.  Rows: 2 x 7 per return.
    """
    cut = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(side).alias("side")) for s in SCALES for side in ("front", "back"))))
    x = prof.select(KEY, "i", "n", "y", cut.alias("c")).select(KEY, "i", "n", "y", "c.*").where("scale <= n div 4")
    # the front leaves out the last n % scale returns, the back the first
    x = x.withColumn("at", F.when(F.col("side") == "front", F.col("i")).otherwise(F.col("i") - F.col("n") % F.col("scale"))).where("at >= 0 AND at < n - n % scale")
    return x.select(KEY, "n", "scale", "side", F.expr("at div scale").alias("segment"), F.expr("at % scale").alias("k"), "y")


def segment_residuals(prof: DataFrame, order: int = 1) -> DataFrame:
    """Mean squared residual of every segment after a polynomial fit; not finite or not positive ones are dropped.

    On equally spaced places the powers are replaced by the orthogonal (Gram)
    polynomials, so each degree takes away (sum y P)^2 / sum P^2 on its own.
    """
    if order not in (0, 1, 2, 3):
        raise ValueError("order must be 0, 1, 2 or 3")
    keys = [KEY, "n", "scale", "side", "segment"]
    size = F.col("scale").cast("double")
    x = F.col("k") - (size - 1) / 2
    gram = (x, x * x - (size * size - 1) / 12, x * x * x - x * (3 * size * size - 7) / 20)[:order]
    s = segments(prof).withColumns({f"p{j}": p for j, p in enumerate(gram, 1)})
    sums = [e.alias(f"{n}{j}") for j in range(1, order + 1) for n, e in (("a", F.sum(F.col("y") * F.col(f"p{j}"))), ("b", F.sum(F.col(f"p{j}") * F.col(f"p{j}"))))]
    out = s.groupBy(*keys).agg((F.var_pop("y") * F.count("*")).alias("syy"), *sums)
    rest = F.col("syy") - sum((F.col(f"a{j}") * F.col(f"a{j}") / F.col(f"b{j}") for j in range(1, order + 1)), F.lit(0.0))
    return out.withColumn("f2", rest / F.col("scale")).where(F.col("f2").isNotNull() & ~F.isnan("f2") & (F.col("f2") > 0)).select(*keys, "f2")


def fluctuation(returns: DataFrame, order: int = 1, q: tuple[int, ...] = (2,)) -> DataFrame:
    """F_q(scale): the generalized mean of segment residuals (geometric for q = 0)."""
    f2 = segment_residuals(profile(_numbered(returns)), order)
    qs = F.explode(F.array(*map(F.lit, q)))
    x = f2.withColumn("q", qs)
    power = F.avg(F.when(F.col("q") != 0, F.pow("f2", F.col("q") / 2.0)))
    g = x.groupBy(KEY, "n", "scale", "q").agg(power.alias("p"), F.avg(F.ln("f2")).alias("l"))
    value = F.when(F.col("q") == 0, F.exp(F.col("l") / 2)).otherwise(F.pow("p", F.lit(1.0) / F.when(F.col("q") != 0, F.col("q"))))
    return g.select(KEY, "n", "scale", "q", value.alias("f"))


def scaling(returns: DataFrame, order: int = 1, q: tuple[int, ...] = ORDERS_Q) -> DataFrame:
    """Slope h(q) and R^2 of ln F_q against ln scale; series under 96 returns give none."""
    f = fluctuation(returns, order, q).where(F.col("n") >= LEAST_RETURNS)
    y, x = F.ln("f"), F.ln("scale")
    out = f.groupBy(KEY, "q").agg(F.regr_slope(y, x).alias("h"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("scales_used"))
    return out.where("scales_used >= 4")


def dfa_hurst(returns: DataFrame, order: int = 1) -> DataFrame:
    return scaling(returns, order, (2,)).drop("q")


def mfdfa_width(returns: DataFrame, order: int = 1) -> DataFrame:
    """h(-2) - h(2)."""
    s = scaling(returns, order, (-2, 2))
    return s.groupBy(KEY).agg((F.max(F.when(F.col("q") == -2, F.col("h"))) - F.max(F.when(F.col("q") == 2, F.col("h")))).alias("width"))


def surrogate(returns: DataFrame, seed: int = 20260918) -> DataFrame:
    """The returns of each instrument in a seeded random order (by md5, the same everywhere)."""
    r = _numbered(returns)
    mixed = r.withColumn("ts", F.md5(F.concat(F.lit(f"{seed}|"), F.col("i").cast("string"))))
    return mixed.select(KEY, "ts", F.col("x").alias("log_ret"))


def resamples(returns: DataFrame, reps: int = 100, seed: int = 20260918) -> DataFrame:
    """Moving-block resamples of every series, as series named ``<instrument>|<rep>`` (ts: their places).

    Blocks hold the square root of the series' length (4 at least) and begin where md5 of seed,
    resample and block says, so the same everywhere; a block's rows are found by an equi-join.
    """
    r = _numbered(returns).select(KEY, "i", "x")
    size = r.groupBy(KEY).agg(F.count("*").alias("n")).withColumn("b", F.greatest(F.lit(4), F.round(F.sqrt("n"))).cast("long")).where("n >= b")
    plan = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("b")) - 1)))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "rep", "block")), 1, 8), 16, 10).cast("long")
    plan = plan.withColumn("start", number % (F.col("n") - F.col("b") + 1)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    plan = plan.select(KEY, "rep", (F.col("block") * F.col("b") + F.col("k")).alias("ts"), (F.col("start") + F.col("k")).alias("i"), "n").where("ts < n")
    return plan.join(r, [KEY, "i"]).select(F.concat_ws("|", KEY, "rep").alias(KEY), "ts", F.col("x").alias("log_ret"))


def bootstrap_hurst(returns: DataFrame, reps: int = 100, seed: int = 20260918, order: int = 1) -> DataFrame:
    """2.5 and 97.5 % quantiles of the exponent over moving-block resamples, null with too few valid ones."""
    h = dfa_hurst(resamples(returns, reps, seed), order).where(F.col("h").isNotNull() & ~F.isnan("h"))
    of = F.regexp_replace(KEY, r"\|\d+$", "")
    enough = F.count("*") >= max(5, reps // 4)
    found = h.groupBy(of.alias(KEY)).agg(F.count("*").alias("valid"), F.when(enough, F.percentile("h", 0.025)).alias("low"), F.when(enough, F.percentile("h", 0.975)).alias("high"))
    every = _numbered(returns).select(KEY).distinct()  # a series too short for an exponent has none and stays
    return every.join(found, KEY, "left").withColumn("valid", F.coalesce("valid", F.lit(0).cast("long")))
