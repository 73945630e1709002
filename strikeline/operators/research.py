"""Research controls and option surfaces: combinatorial folds, overfitting, trial ledger, protocol, implied volatility."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.operators.validation import chronological_folds, deflated_sharpe

# The controls a protocol must switch on, and the fields of an experiment manifest.
FLAGS = ("purging", "embargo", "cpcv", "dsr", "pbo", "untouched_holdout")
LEDGER_FIELDS = (
    "experiment_id",
    "hypothesis_ids",
    "universe",
    "frequency",
    "dataset_id",
    "feature_set_id",
    "model_family",
    "parameter_grid",
    "train_period",
    "validation_period",
    "test_period",
    "embargo",
    "purge_horizon",
    "transaction_cost_model",
    "random_seed",
    "trial_count",
    "code_commit",
    "status",
)
# Rational approximation of the normal distribution (Hart 5666), highest power first.
_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


# --- folds and overfitting ------------------------------------------------------


def combinatorial_plan(spark: SparkSession, folds: int, held: int) -> DataFrame:
    """Every choice of ``held`` test folds: split, fold, is_test, and the path a test fold belongs to.

    The j-th split that tests a fold gives that fold to path j, so every path runs through all folds once.
    """
    if not 0 < held < folds:
        raise ValueError("held must lie between 0 and folds")
    seen = [0] * folds
    rows = []
    for split, tested in enumerate(combinations(range(folds), held)):
        for fold in range(folds):
            path = None
            if fold in tested:
                path, seen[fold] = seen[fold], seen[fold] + 1
            rows.append((split, fold, fold in tested, path))
    return spark.createDataFrame(rows, "split int, fold int, is_test boolean, path int")


def combinatorial_training(samples: DataFrame, folds: int, held: int, label_end: str = "label_end", at: str = "ts", embargo_seconds: int = 0) -> DataFrame:
    """(split, sample): training rows of every split whose label interval meets no test span of it nor an embargo.

    Both broadcast sides have one row per split and fold, whatever the samples.
    """
    x = chronological_folds(samples, folds, at)
    plan = combinatorial_plan(samples.sparkSession, folds, held)
    span = x.groupBy("fold").agg(F.min(at).alias("__from"), (F.max(label_end) + F.make_dt_interval(secs=F.lit(float(embargo_seconds)))).alias("__to"))
    tested = plan.where("is_test").join(span, "fold").select(F.col("split").alias("__split"), "__from", "__to")
    train = x.join(F.broadcast(plan.where("NOT is_test").select("split", "fold")), "fold")
    meets = (F.col("split") == F.col("__split")) & (F.col(at) <= F.col("__to")) & (F.col(label_end) >= F.col("__from"))
    return train.join(F.broadcast(tested), meets, "left_anti")


def overfitting_splits(returns: DataFrame, blocks: int = 6, trial: str = "instrument_id", at: str = "ts", x: str = "ret") -> DataFrame:
    """Combinatorially symmetric splits: the trial that is best inside, its Sharpe ratios, its rank outside and the logit of it.

    Returns shrink to three sums per trial and block before anything meets the
    splits.  Ties of the best go to the smallest trial; ``outside_rank`` counts
    the trials not above it.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even")
    r = chronological_folds(returns.where(F.col(x).isNotNull()).select(F.col(trial).alias("trial"), at, F.col(x).alias("x")), blocks, at)
    sums = r.groupBy("trial", "fold").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    halves = combinatorial_plan(returns.sparkSession, blocks, blocks // 2).select("split", "fold", F.col("is_test").alias("inside"))

    def sharpe(side: Column) -> Column:
        n, s, q = (F.sum(F.when(side, F.col(c))) for c in ("n", "s", "q"))
        return F.try_divide(s / n, F.sqrt(F.greatest(F.try_divide(q - s * s / n, n - 1), F.lit(0.0))))

    both = sums.join(F.broadcast(halves), "fold").groupBy("split", "trial").agg(sharpe(F.col("inside")).alias("inside"), sharpe(~F.col("inside")).alias("outside")).where("inside IS NOT NULL AND outside IS NOT NULL")
    best = both.groupBy("split").agg(F.min(F.struct((-F.col("inside")).alias("low"), "trial", "inside", "outside")).alias("best"))
    ranked = both.join(best, "split").groupBy("split", "best").agg(F.count_if(F.col("outside") <= F.col("best.outside")).alias("outside_rank"), F.count("*").alias("trials"))
    share = F.col("outside_rank") / (F.col("trials") + 1)
    return ranked.select("split", F.col("best.trial").alias("trial"), F.col("best.inside").alias("inside"), F.col("best.outside").alias("outside"), "outside_rank", "trials", F.ln(share / (1 - share)).alias("logit"))


def overfitting_probability(splits: DataFrame) -> DataFrame:
    """The share of splits whose best trial inside lies in the lower half outside."""
    return splits.agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"), F.avg((F.col("outside") < 0).cast("int")).alias("loss_share"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, to 1e-14; 0 or 1 beyond seven deviations."""

    def polynomial(coefficients: Iterable[float], x: Column) -> Column:
        total = F.lit(0.0)
        for c in coefficients:
            total = total * x + F.lit(c)
        return total

    x = F.abs(z)
    tail = F.when(x > 7, F.lit(0.0)).otherwise(F.exp(-x * x / 2) * polynomial(_UPPER, x) / polynomial(_LOWER, x))
    return F.when(z > 0, 1 - tail).when(z <= 0, tail)


def sharpe_probability(returns: DataFrame, key: str = "instrument_id", x: str = "ret") -> DataFrame:
    """The deflated Sharpe ratio as a probability, per trial."""
    return deflated_sharpe(returns, key, x).withColumn("dsr", normal_cdf(F.col("z")))


def mean_interval(values: DataFrame, lags: int, key: str = "instrument_id", at: str = "ts", x: str = "vrp", z: float = 1.959963984540054) -> DataFrame:
    """Mean with an interval that allows for autocorrelation up to ``lags`` (Bartlett weights)."""
    v = values.where(F.col(x).isNotNull()).select(key, at, F.col(x).alias("x"))
    mean = v.groupBy(key).agg(F.avg("x").alias("mean"))
    w = Window.partitionBy(key).orderBy(at)
    # products of lagged values and the sums that take their means out: one window, no second pass
    d = v.select(key, "x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    sums = [F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("p0"), F.sum("x").alias("s")]
    for k in range(1, lags + 1):
        both = F.col(f"l{k}").isNotNull()
        sums += [F.sum(F.col("x") * F.col(f"l{k}")).alias(f"p{k}"), F.sum(F.when(both, F.col("x") + F.col(f"l{k}"))).alias(f"s{k}"), F.count_if(both).alias(f"n{k}")]
    a = d.groupBy(key).agg(*sums).join(mean, key)
    m = F.col("mean")
    total = F.col("p0") - F.col("n") * m * m
    for k in range(1, lags + 1):
        moved = F.col(f"p{k}") - m * F.col(f"s{k}") + F.col(f"n{k}") * m * m
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(moved, F.lit(0.0))
    error = F.sqrt(F.greatest(total, F.lit(0.0))) / F.col("n")
    return a.select(key, "n", "mean", error.alias("error"), (m - z * error).alias("low"), (m + z * error).alias("high"))


def turnover(positions: DataFrame, key: str = "instrument_id", at: str = "ts", weight: str = "weight") -> DataFrame:
    """Per series the weight traded: absolute changes of the position, the first from nothing; a missing weight is none."""
    held = F.coalesce(F.col(weight), F.lit(0.0))
    moved = F.abs(held - F.lag(held, 1, 0.0).over(Window.partitionBy(key).orderBy(at)))
    return positions.select(key, moved.alias("moved")).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("moved") > 0).alias("trades"), F.sum("moved").alias("turnover"), F.avg("moved").alias("mean_turnover"))


def tenor_rate(observations: DataFrame, rates: DataFrame, on: Sequence[str], row_col: str, days: str = "days") -> DataFrame:
    """Observations with the rate at their days to expiry, between the two nearest tenors of the curve ``on`` names.

    ``rates`` has the columns ``on``, tenor and rate, once per tenor.  Outside a
    curve its end holds; without a curve the rate is null.  The join aggregates
    per row, so a curve of any length costs one row.
    """
    o = observations.select(F.col(row_col).alias("__row"), F.col(days).cast("double").alias("__days"), *on)
    point = F.struct(F.col("tenor").cast("double").alias("t"), F.col("rate").cast("double").alias("r"))
    r = rates.where(F.col("tenor").isNotNull() & F.col("rate").isNotNull()).select(*on, point.alias("p"))
    near = o.join(r, list(on)).groupBy("__row", "__days").agg(F.max(F.when(F.col("p.t") <= F.col("__days"), F.col("p"))).alias("a"), F.min(F.when(F.col("p.t") >= F.col("__days"), F.col("p"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    between = a["r"] + (b["r"] - a["r"]) * F.coalesce(F.try_divide(F.col("__days") - a["t"], b["t"] - a["t"]), F.lit(0.0))
    found = near.select("__row", F.when(a.isNull(), b["r"]).when(b.isNull(), a["r"]).otherwise(between).alias("rate"))
    return observations.join(found, F.col(row_col) == F.col("__row"), "left").drop("__row")


# --- ledger and protocol --------------------------------------------------------


def append_trials(trials: DataFrame, path: str) -> None:
    """Append trials to the ledger at ``path``; nothing is ever replaced there."""
    if missing := [f for f in (*LEDGER_FIELDS, "trial_id") if f not in trials.columns]:
        raise ValueError(f"trials lack {missing}")
    trials.write.mode("append").parquet(path)


def ledger_report(ledger: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per experiment: trials announced and recorded, those that are missing or logged twice, rejected ones, and values searched per dimension."""
    known = F.count_distinct("trial_id")
    a = ledger.groupBy("experiment_id").agg(
        F.max("trial_count").cast("long").alias("announced"),
        known.alias("trials"),
        (F.count("trial_id") - known).alias("repeated"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        *(F.count_distinct(d).alias(f"n_{d}") for d in dimensions),
    )
    silent = F.greatest(F.col("announced") - F.col("trials"), F.lit(0))
    return a.withColumns({"discarded": silent, "complete": F.col("announced").isNotNull() & (silent == 0)})


def protocol_checks(files: DataFrame, required: Sequence[str], config: str, plan: str, hypotheses: str, phases: int = 10, tracks: str = "ABCDEFGH") -> DataFrame:
    """(check, item, passed) over the few texts of a study (path, text): files that exist, controls that are on, phases and tracks that are named."""
    wanted = [("file", p, p) for p in required]
    wanted += [("flag", f, config) for f in FLAGS]
    wanted += [("phase", f"Phase {i}", plan) for i in range(phases)]
    wanted += [("track", f"H-{t}", hypotheses) for t in tracks]
    items = files.sparkSession.createDataFrame(wanted, "check string, item string, path string")
    said = items.join(files.groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")), "path", "left")
    on = F.get_json_object("text", "$.validation").contains(F.concat(F.lit('"'), F.col("item"), F.lit('":true')))
    passed = F.when(F.col("check") == "file", F.col("text").isNotNull()).when(F.col("check") == "flag", on).otherwise(F.col("text").contains(F.col("item")))
    return said.select("check", "item", F.coalesce(passed, F.lit(False)).alias("passed"))


# --- surfaces -------------------------------------------------------------------


def black_price(forward: Column, strike: Column, years: Column, vol: Column, call: Column) -> Column:
    """Undiscounted price of an option on a forward."""
    spread = vol * F.sqrt(years)
    d1 = F.ln(forward / strike) / spread + spread / 2
    value = forward * normal_cdf(d1) - strike * normal_cdf(d1 - spread)
    return F.when(call, value).otherwise(value - forward + strike)


def _distribution(z: np.ndarray) -> np.ndarray:
    """``normal_cdf`` over an array."""

    def polynomial(coefficients: Iterable[float], x: np.ndarray) -> np.ndarray:
        total = np.zeros_like(x)
        for c in coefficients:
            total *= x
            total += c
        return total

    x = np.abs(z)
    tail = np.where(x > 7, 0.0, np.exp(-x * x / 2) * polynomial(_UPPER, x) / polynomial(_LOWER, x))
    return np.where(z > 0, 1 - tail, tail)


def _bisected(price: np.ndarray, forward: np.ndarray, strike: np.ndarray, years: np.ndarray, call: np.ndarray, highest: float, steps: int) -> np.ndarray:
    """The volatilities of one batch; NaN where there is none."""
    with np.errstate(all="ignore"):
        ratio = forward / strike
        usable = (price > np.maximum(np.where(call, forward - strike, strike - forward), 0.0)) & (price < np.where(call, forward, strike))
        usable &= (years > 0) & np.isfinite(years) & (forward > 0) & (strike > 0) & (ratio > 0) & np.isfinite(ratio)
    out = np.full(len(price), np.nan)
    price, forward, strike, call = price[usable], forward[usable], strike[usable], call[usable]
    root, log = np.sqrt(years[usable]), np.log(ratio[usable])
    low, high = np.zeros(len(price)), np.full(len(price), float(highest))
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(steps):
            middle = (low + high) / 2
            spread = middle * root
            d1 = log / spread + spread / 2
            value = forward * _distribution(d1) - strike * _distribution(d1 - spread)
            below = np.where(call, value, value - forward + strike) < price
            low, high = np.where(below, middle, low), np.where(below, high, middle)
    found = (low + high) / 2
    out[usable] = np.where(found < highest - 1e-9, found, np.nan)
    return out


def implied_vol(price: Column, forward: Column, strike: Column, years: Column, call: Column, highest: float = 5.0, steps: int = 50) -> Column:
    """The volatility at which the option costs ``price``, by bisection; null outside its bounds.

    All rows of an Arrow batch are halved together; as a lambda the JVM
    interprets the steps node by node.
    """

    def run(price: pa.Array, forward: pa.Array, strike: pa.Array, years: pa.Array, call: pa.Array) -> pa.Array:
        numbers = (pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in (price, forward, strike, years))
        return pa.array(_bisected(*numbers, call.to_numpy(zero_copy_only=False), highest, steps), pa.float64(), from_pandas=True)

    at = (c.cast("double") for c in (price, forward, strike, years))
    return F.arrow_udf(run, "double")(*at, F.coalesce(call, F.lit(False)))


def surface(quotes: DataFrame, keys: Sequence[str], tenor_days: int = 30, moneyness_step: float = 0.05) -> DataFrame:
    """Mean implied volatility per tenor bucket and log-moneyness bucket."""
    tenor = F.floor(F.col("days") / tenor_days).cast("int")
    place = F.floor(F.ln(F.col("strike") / F.col("forward")) / moneyness_step).cast("int")
    return quotes.where(F.col("vol").isNotNull()).groupBy(*keys, tenor.alias("tenor"), place.alias("moneyness")).agg(F.count("*").alias("n"), F.avg("vol").alias("vol"))


def sabr_vol(forward: Column, strike: Column, years: Column, alpha: Column, beta: float, rho: Column, nu: Column) -> Column:
    """Lognormal volatility of the SABR model (expansion of Hagan et al., 2002)."""
    b, log = 1 - beta, F.ln(forward / strike)
    middle = F.pow(forward * strike, F.lit(b / 2))
    z = nu / alpha * middle * log
    x = F.ln((F.sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho))
    ratio = F.when(F.abs(z) < 1e-7, F.lit(1.0)).otherwise(z / x)
    below = middle * (1 + b * b / 24 * log * log + b**4 / 1920 * F.pow(log, F.lit(4.0)))
    drift = b * b / 24 * alpha * alpha / (middle * middle) + rho * beta * nu * alpha / (4 * middle) + (2 - 3 * rho * rho) / 24 * nu * nu
    return alpha / below * ratio * (1 + drift * years)


def calibrate_sabr(quotes: DataFrame, keys: Sequence[str], alphas: Sequence[float], rhos: Sequence[float], nus: Sequence[float], beta: float = 0.5) -> DataFrame:
    """Per smile the parameters of a grid with the least squared error (ties: the smallest).

    A quote meets the grid in one expression; errors are summed map-side, so the
    shuffle holds one row per smile and grid point, whatever the quotes.
    """
    if not all(-1 < r < 1 for r in rhos) or not all(a > 0 for a in alphas) or not all(n >= 0 for n in nus):
        raise ValueError("alpha > 0, -1 < rho < 1, nu >= 0")
    grid = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(r)).alias("rho"), F.lit(float(n)).alias("nu")) for a in alphas for r in rhos for n in nus))
    x = quotes.where(F.col("vol").isNotNull()).select(*keys, "forward", "strike", "years", "vol", F.explode(grid).alias("g"))
    off = sabr_vol(F.col("forward"), F.col("strike"), F.col("years"), F.col("g.alpha"), beta, F.col("g.rho"), F.col("g.nu")) - F.col("vol")
    errors = x.groupBy(*keys, "g").agg(F.count("*").alias("n"), F.sum(off * off).alias("sse"))
    best = errors.groupBy(*keys).agg(F.min(F.struct("sse", "g", "n")).alias("best"))
    return best.select(*keys, F.col("best.g.alpha").alias("alpha"), F.col("best.g.rho").alias("rho"), F.col("best.g.nu").alias("nu"), F.col("best.n").alias("n"), F.sqrt(F.col("best.sse") / F.col("best.n")).alias("rmse"))
