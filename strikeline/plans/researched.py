"""Queries over research controls and option surfaces, beside the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.operators import diagnostics as D
from strikeline.operators import research
from strikeline.plans import views as V
from strikeline.plans.catalog import _VOL, register, rounded
from strikeline.sources import shared

_FOLDS = """s AS (SELECT o_orderkey, o_orderdate AS ts, o_orderdate + INTERVAL 5 DAY AS label_end, epoch(o_orderdate) AS e FROM orders
), m AS (SELECT min(e) AS a, max(e) AS b FROM s), f AS (SELECT s.*, CAST(least(floor((e - a) / (b - a) * 5), 4) AS INT) AS fold FROM s, m
), span AS (SELECT fold, min(ts) AS t0, max(label_end) + INTERVAL 1 DAY AS t1 FROM f GROUP BY 1
), pairs AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS split, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM range(5) x(a), range(5) y(b) WHERE a < b)"""


@register("WITH pairs AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS split, a, b FROM range(5) x(a), range(5) y(b) WHERE a < b), t AS (SELECT split, CAST(fold AS INT) AS fold, fold IN (a, b) AS is_test FROM pairs, range(5) z(fold)) SELECT *, CASE WHEN is_test THEN CAST(row_number() OVER (PARTITION BY fold, is_test ORDER BY split) - 1 AS INT) END AS path FROM t")
def cpcv_plan(spark, sf):
    return research.combinatorial_plan(spark, 5, 2)


@register(
    f"""WITH {_FOLDS} SELECT split, f.fold, count(*) AS n FROM f JOIN pairs ON f.fold <> a AND f.fold <> b JOIN span x ON x.fold = a JOIN span y ON y.fold = b
WHERE NOT (f.ts <= x.t1 AND f.label_end >= x.t0) AND NOT (f.ts <= y.t1 AND f.label_end >= y.t0) GROUP BY 1, 2"""
)
def cpcv_training(spark, sf):
    s = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("label_end"))
    return research.combinatorial_training(s, 5, 2, embargo_seconds=86_400).groupBy("split", "fold").agg(F.count("*").alias("n"))


_SPLITS = f"""WITH {V.RETURNS}, x AS (SELECT instrument_id AS trial, epoch(ts) AS e, ret FROM returns WHERE ret IS NOT NULL), m AS (SELECT min(e) AS a, max(e) AS b FROM x
), f AS (SELECT trial, ret, CAST(least(floor((e - a) / (b - a) * 4), 3) AS INT) AS fold FROM x, m
), pairs AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS split, a, b FROM range(4) x(a), range(4) y(b) WHERE a < b
), sharpes AS (SELECT split, trial, avg(ret) FILTER (fold IN (a, b)) / stddev_samp(ret) FILTER (fold IN (a, b)) AS inside, avg(ret) FILTER (fold NOT IN (a, b)) / stddev_samp(ret) FILTER (fold NOT IN (a, b)) AS outside FROM f, pairs GROUP BY 1, 2
), best AS (SELECT * FROM sharpes QUALIFY row_number() OVER (PARTITION BY split ORDER BY inside DESC, trial) = 1
), ranked AS (SELECT b.split, b.trial, b.inside, b.outside, count(*) FILTER (s.outside <= b.outside) AS outside_rank, count(*) AS trials FROM best b JOIN sharpes s USING (split) GROUP BY ALL
), splits AS (SELECT *, ln(outside_rank / (trials + 1) / (1 - outside_rank / (trials + 1))) AS logit FROM ranked)"""


def _splits(spark, sf):
    return research.overfitting_splits(D.returns(V.hourly_bars(spark, sf)), 4)


@register(f"{_SPLITS} SELECT split, trial, round(inside, 9) + 0.0 AS inside, round(outside, 9) + 0.0 AS outside, outside_rank, trials, round(logit, 9) + 0.0 AS logit FROM splits")
def overfitting_splits(spark, sf):
    return rounded(_splits(spark, sf))


@register(f"{_SPLITS} SELECT count(*) AS splits, round(avg(CAST(logit <= 0 AS INT)), 9) + 0.0 AS pbo, round(avg(CAST(outside < 0 AS INT)), 9) + 0.0 AS loss_share FROM splits")
def overfitting_probability(spark, sf):
    return rounded(research.overfitting_probability(_splits(spark, sf)))


@register(
    f"""WITH {V.RETURNS}, a AS (SELECT instrument_id, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM returns GROUP BY 1
), t AS (SELECT coalesce(stddev_samp(sharpe), 0) * sqrt(2 * ln(greatest(count(sharpe), 2))) AS top FROM a
), z AS (SELECT instrument_id, n, greatest(-8, least(8, (sharpe - top) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe, 1e-12)))) AS z FROM a, t
), simpson AS (SELECT instrument_id, n, z, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * k / 4000, 2) / 2)) * z / 12000 AS part FROM z, range(4001) g(k) GROUP BY 1, 2, 3)
SELECT instrument_id, n, round(0.5 + part / sqrt(2 * pi()), 9) + 0.0 AS dsr FROM simpson"""
)
def sharpe_probability(spark, sf):
    """The SQL integrates the density; the operator has a closed form."""
    return rounded(research.sharpe_probability(D.returns(V.hourly_bars(spark, sf))).select("instrument_id", "n", "dsr"))


@register(
    f"""WITH {_VOL}, x AS (SELECT instrument_id, ts, vol * vol - log_ret * log_ret AS vrp FROM vols), k AS (SELECT * FROM x WHERE vrp IS NOT NULL
), d AS (SELECT *, vrp - avg(vrp) OVER (PARTITION BY instrument_id) AS d FROM k), l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM d WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
), e AS (SELECT instrument_id, count(*) AS n, avg(vrp) AS mean, sqrt(greatest(sum(d * d) + 1.5 * coalesce(sum(d * d1), 0) + coalesce(sum(d * d2), 0) + 0.5 * coalesce(sum(d * d3), 0), 0)) / count(*) AS error FROM l GROUP BY 1)
SELECT instrument_id, n, round(mean, 9) + 0.0 AS mean, round(error, 9) + 0.0 AS error, round(mean - 1.959963984540054 * error, 9) + 0.0 AS low, round(mean + 1.959963984540054 * error, 9) + 0.0 AS high FROM e"""
)
def premium_interval(spark, sf):
    bars = V.hourly_bars(spark, sf)
    vol = D.rolling_vol(bars).select("instrument_id", "ts", (F.col("vol") * F.col("vol")).alias("v"))
    gap = vol.join(D.returns(bars), ["instrument_id", "ts"]).select("instrument_id", "ts", (F.col("v") - F.col("log_ret") * F.col("log_ret")).alias("vrp"))
    return rounded(research.mean_interval(gap, 3))


@register(
    f"""WITH {V.RETURNS}, p AS (SELECT instrument_id, ts, CASE WHEN ret > 0 THEN 1.0 WHEN ret < 0 THEN -0.5 END AS weight FROM returns
), m AS (SELECT instrument_id, abs(coalesce(weight, 0) - lag(coalesce(weight, 0), 1, 0) OVER (PARTITION BY instrument_id ORDER BY ts)) AS moved FROM p)
SELECT instrument_id, count(*) AS n, count(*) FILTER (moved > 0) AS trades, CAST(sum(moved) AS DOUBLE) AS turnover, round(CAST(avg(moved) AS DOUBLE), 9) + 0.0 AS mean_turnover FROM m GROUP BY 1"""
)
def turnover(spark, sf):
    weight = F.when(F.col("ret") > 0, 1.0).when(F.col("ret") < 0, -0.5)
    return rounded(research.turnover(D.returns(V.hourly_bars(spark, sf)).select("instrument_id", "ts", weight.alias("weight"))))


@register(
    """WITH o AS (SELECT s_suppkey, s_nationkey % 6 AS curve, s_suppkey % 130 AS days FROM supplier), c AS (SELECT n_regionkey AS curve, 5 * n_nationkey AS tenor, (n_nationkey * 7 % 11)::DOUBLE / 100 AS rate FROM nation
), a AS (SELECT s_suppkey, max(tenor) AS t0, arg_max(rate, tenor) AS r0 FROM o JOIN c USING (curve) WHERE tenor <= days GROUP BY 1), b AS (SELECT s_suppkey, min(tenor) AS t1, arg_min(rate, tenor) AS r1 FROM o JOIN c USING (curve) WHERE tenor >= days GROUP BY 1)
SELECT s_suppkey, curve, days, round(CASE WHEN t0 IS NULL THEN r1 WHEN t1 IS NULL OR t1 = t0 THEN r0 ELSE r0 + (r1 - r0) * (days - t0) / (t1 - t0) END, 9) + 0.0 AS rate FROM o LEFT JOIN a USING (s_suppkey) LEFT JOIN b USING (s_suppkey)"""
)
def tenor_rates(spark, sf):
    o = V.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 6).alias("curve"), (F.col("s_suppkey") % 130).alias("days"))
    curves = V.table(spark, sf, "nation").select(F.col("n_regionkey").alias("curve"), (5 * F.col("n_nationkey")).alias("tenor"), ((F.col("n_nationkey") * 7 % 11).cast("double") / 100).alias("rate"))
    return rounded(research.tenor_rate(o, curves, ("curve",), "s_suppkey"))


_DIMENSIONS = ("parameter_grid", "model_family", "universe")


@register(
    """WITH t AS (SELECT o_orderpriority AS experiment_id, o_custkey AS trial_id, CASE o_orderstatus WHEN 'F' THEN 'REJECTED' ELSE 'CANDIDATE' END AS status, o_custkey % 7 AS p, o_orderstatus AS f, year(o_orderdate) AS u FROM orders
), a AS (SELECT experiment_id, CAST(60 AS BIGINT) AS announced, count(DISTINCT trial_id) AS trials, count(trial_id) - count(DISTINCT trial_id) AS repeated, count(*) FILTER (status = 'REJECTED') AS rejected,
  count(DISTINCT p) AS n_parameter_grid, count(DISTINCT f) AS n_model_family, count(DISTINCT u) AS n_universe FROM t GROUP BY 1)
SELECT *, greatest(announced - trials, 0) AS discarded, announced <= trials AS complete FROM a"""
)
def trial_ledger(spark, sf):
    """Two appends to one ledger, read back and reported."""
    o = V.table(spark, sf, "orders")
    own = {"experiment_id": F.col("o_orderpriority"), "trial_id": F.col("o_custkey"), "status": F.when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("CANDIDATE"), "parameter_grid": (F.col("o_custkey") % 7).cast("string"), "model_family": F.col("o_orderstatus"), "universe": F.year("o_orderdate").cast("string"), "trial_count": F.lit(60)}
    trials = o.select(*(own.get(f, F.lit("x")).alias(f) for f in (*research.LEDGER_FIELDS, "trial_id")))
    path = shared.fresh(spark, "trials")
    for failed in (True, False):
        research.append_trials(trials.where((F.col("status") == "REJECTED") == failed), path)
    return research.ledger_report(spark.read.schema(trials.schema).parquet(path), _DIMENSIONS)


@register(
    """WITH t AS (SELECT lower(r_name) AS path, CASE r_regionkey WHEN 0 THEN 'purging embargo cpcv dsr' WHEN 1 THEN 'Phase 0, Phase 3 and Phase 9' WHEN 2 THEN 'H-A1 H-C2' ELSE r_name END AS text FROM region
), w AS (SELECT 'file' AS c, unnest(['africa', 'america', 'asia', 'atlantis']) AS item, NULL AS path UNION ALL SELECT 'flag', unnest(['purging', 'embargo', 'cpcv', 'dsr', 'pbo', 'untouched_holdout']), 'africa'
  UNION ALL SELECT 'phase', 'Phase ' || unnest(range(10)), 'america' UNION ALL SELECT 'track', 'H-' || unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H']), 'asia')
SELECT c AS "check", item, CASE c WHEN 'file' THEN item IN (SELECT path FROM t) ELSE contains((SELECT text FROM t WHERE t.path = w.path), item) END AS passed FROM w"""
)
def protocol_checks(spark, sf):
    """Texts of a study named after regions: a configuration, a plan and hypotheses."""
    config = '{"validation": {"purging": true, "embargo" : true, "cpcv":true, "dsr": true, "pbo": false, "threshold": 0.95}, "untouched_holdout": true}'
    key = F.col("r_regionkey")
    said = F.when(key == 0, config).when(key == 1, "Phase 0, Phase 3 and Phase 9").when(key == 2, "H-A1 H-C2").otherwise(F.col("r_name"))
    texts = V.table(spark, sf, "region").select(F.lower("r_name").alias("path"), said.alias("text"))
    return research.protocol_checks(texts, ("africa", "america", "asia", "atlantis"), "africa", "america", "asia")


def _quotes(spark, sf):
    """One option per part: a smile per brand."""
    size = F.col("p_size").cast("double")
    strike = 80 + size
    return V.table(spark, sf, "part").select("p_partkey", "p_brand", F.lit(100.0).alias("forward"), strike.alias("strike"), F.lit(0.5).alias("years"), (F.col("p_partkey") % 90).alias("days"), (0.2 + F.pow((strike - 100) / 100, F.lit(2.0)) + F.col("p_partkey") % 10 / 1000).alias("vol"))


_QUOTES = "q AS (SELECT p_partkey, p_brand, 100.0::DOUBLE AS forward, 80 + p_size::DOUBLE AS strike, 0.5::DOUBLE AS years, p_partkey % 90 AS days, 0.2::DOUBLE + pow((p_size - 20)::DOUBLE / 100, 2) + (p_partkey % 10)::DOUBLE / 1000 AS vol FROM part)"


@register(f"WITH {_QUOTES} SELECT p_partkey, round(vol, 6) + 0.0 AS vol FROM q")
def implied_vols(spark, sf):
    """Prices at known volatilities give those volatilities back."""
    q, call = _quotes(spark, sf), F.col("strike") >= 100
    at = [F.col(c) for c in ("forward", "strike", "years")]
    priced = q.withColumn("price", research.black_price(*at, F.col("vol"), call))
    return rounded(priced.select("p_partkey", research.implied_vol(F.col("price"), *at, call).alias("vol")), 6)


@register(f"WITH {_QUOTES} SELECT p_brand, CAST(floor(days / 30) AS INT) AS tenor, CAST(floor(ln(strike / forward) / 0.05) AS INT) AS moneyness, count(*) AS n, round(avg(vol), 9) + 0.0 AS vol FROM q GROUP BY 1, 2, 3")
def vol_surface(spark, sf):
    return rounded(research.surface(_quotes(spark, sf), ("p_brand",)))


_ALPHAS, _RHOS, _NUS = (1.8, 2.0, 2.2), (-0.3, 0.0, 0.3), (0.3, 0.8, 1.3)


@register(
    f"""WITH {_QUOTES}, g AS (SELECT alpha, rho, nu FROM (SELECT unnest([1.8::DOUBLE, 2.0, 2.2]) AS alpha), (SELECT unnest([-0.3::DOUBLE, 0.0, 0.3]) AS rho), (SELECT unnest([0.3::DOUBLE, 0.8, 1.3]) AS nu)
), a AS (SELECT *, pow(forward * strike, 0.25) AS mid, ln(forward / strike) AS l, nu / alpha * pow(forward * strike, 0.25) * ln(forward / strike) AS z FROM q, g
), b AS (SELECT *, CASE WHEN abs(z) < 1e-7 THEN 1.0::DOUBLE ELSE z / ln((sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho)) END AS ratio FROM a
), c AS (SELECT *, alpha / (mid * (1 + l * l / 96 + pow(l, 4) / 30720)) * ratio * (1 + (alpha * alpha / 96 / (mid * mid) + rho * nu * alpha / (8 * mid) + (2 - 3 * rho * rho) / 24 * nu * nu) * years) - vol AS off FROM b
), e AS (SELECT p_brand, alpha, rho, nu, count(*) AS n, sqrt(avg(off * off)) AS rmse FROM c GROUP BY ALL)
SELECT p_brand, alpha, rho, nu, n, round(rmse, 9) + 0.0 AS rmse FROM e QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rmse, alpha, rho, nu) = 1"""
)
def sabr_smiles(spark, sf):
    return rounded(research.calibrate_sabr(_quotes(spark, sf), ("p_brand",), _ALPHAS, _RHOS, _NUS))
