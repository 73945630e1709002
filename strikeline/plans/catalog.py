"""Named queries over the star-schema tables and the SQL that states the same result."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline.functions import parsing as P
from strikeline.functions.series import drawdown as drawdown_of
from strikeline.functions.series import ordered
from strikeline.operators import bars as B
from strikeline.operators import diagnostics as D
from strikeline.operators import discovery as X
from strikeline.operators import memory as M
from strikeline.operators import pit, quality, reconcile, regimes, validation
from strikeline.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to ``digits`` places, so that another order of summation shows no difference (and no minus zero)."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in names)


# --- bars, returns, windows -------------------------------------------------


@register(f"WITH {V.BARS} SELECT * FROM bars")
def ohlc_bars(spark, sf):
    return V.hourly_bars(spark, sf)


@register(f"WITH {V.RETURNS} SELECT instrument_id, ts, close, {r('ret', 'log_ret')} FROM returns")
def returns(spark, sf):
    return rounded(D.returns(V.hourly_bars(spark, sf)))


@register(f"WITH {V.BARS} SELECT instrument_id, ts, round(close / max(close) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 9) + 0.0 AS drawdown FROM bars")
def drawdown(spark, sf):
    return rounded(V.hourly_bars(spark, sf).select("instrument_id", "ts", drawdown_of("close", ordered()).alias("drawdown")))


_VOL = (
    V.RETURNS
    + """, counted AS (
  SELECT instrument_id, ts, log_ret, stddev_samp(log_ret) OVER w AS vol, count(log_ret) OVER w AS k FROM returns WHERE log_ret IS NOT NULL
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING)
), vols AS (SELECT instrument_id, ts, log_ret, vol FROM counted WHERE k = 20)"""
)


@register(f"WITH {_VOL} SELECT instrument_id, ts, {r('vol')} FROM vols")
def rolling_vol(spark, sf):
    return rounded(D.rolling_vol(V.hourly_bars(spark, sf)))


@register(
    f"""WITH {_VOL} SELECT instrument_id, count(*) AS n, round(avg(vol), 9) + 0.0 AS mean_vol, round(median(vol), 9) + 0.0 AS median_vol,
  round(min(vol), 9) + 0.0 AS min_vol, round(max(vol), 9) + 0.0 AS max_vol FROM vols GROUP BY instrument_id"""
)
def rolling_vol_summary(spark, sf):
    return rounded(D.rolling_vol_summary(V.hourly_bars(spark, sf)))


@register(
    """WITH m AS (
  SELECT event_type AS instrument_id, date_trunc('minute', ts) AS t, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c
  FROM events WHERE value > 0 GROUP BY 1, date_trunc('minute', ts)
), z AS (SELECT *, t + INTERVAL 330 MINUTE AS local FROM m)
SELECT instrument_id, CAST(CAST(local AS DATE) AS VARCHAR) AS session, first(o ORDER BY t) AS open, max(h) AS high, min(l) AS low, last(c ORDER BY t) AS close, count(*) AS minutes
FROM z WHERE hour(local) * 60 + minute(local) BETWEEN 555 AND 930 GROUP BY 1, 2"""
)
def session_bars(spark, sf):
    ticks = V.table(spark, sf, "events").where("value > 0")
    minutes = B.bars(ticks, "event_type", F.date_trunc("minute", "ts"), "value", ("ts", "event_id"))
    return B.sessionize(minutes).withColumn("session", F.col("session").cast("string"))


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_keep_first(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return B.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@register(
    f"""SELECT l_returnflag, is_duplicate, count(*) AS n FROM (
  SELECT l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(V.ROW_ORDER)}) > 1 AS is_duplicate FROM lineitem) GROUP BY ALL"""
)
def duplicate_flags(spark, sf):
    flagged = B.duplicate_flags(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], V.ROW_ORDER)
    return flagged.groupBy("l_returnflag", "is_duplicate").agg(F.count("*").alias("n"))


@register("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_count(spark, sf):
    return B.duplicate_count(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    """WITH p AS (SELECT event_type AS instrument_id, value AS open, value AS close, value - 1 AS high, value - 2 AS low FROM events)
SELECT instrument_id, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS inconsistent, count(*) AS n_rows FROM p GROUP BY 1"""
)
def price_guards(spark, sf):
    v = F.col("value")
    return B.guard_prices(V.table(spark, sf, "events").select(F.col("event_type").alias("instrument_id"), v.alias("open"), v.alias("close"), (v - 1).alias("high"), (v - 2).alias("low")))


@register(
    """SELECT event_type AS instrument_id, count(*) FILTER (ts <= b) AS violations, count(*) AS n_rows
FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS b FROM events) GROUP BY 1"""
)
def order_violations(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_type").alias("instrument_id"), "ts", F.struct("user_id", "event_id").alias("source_row"))
    return B.order_violations(rows)


# --- diagnostics ------------------------------------------------------------


@register(
    f"""WITH {V.RETURNS}, x AS (
  SELECT *, abs(ret) AS a, lag(abs(ret), 1) OVER w AS a1, lag(abs(ret), 5) OVER w AS a5, close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd
  FROM returns WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
)
SELECT instrument_id, count(*) AS n_rows, count(ret) AS n_returns, round(avg(ret), 9) + 0.0 AS mean_return, round(stddev_samp(ret), 9) + 0.0 AS sd_return,
  round(skewness(ret), 9) + 0.0 AS skewness, round(kurtosis(ret), 9) + 0.0 AS excess_kurtosis, round(stddev_samp(log_ret), 9) + 0.0 AS sd_log_return,
  round(CASE WHEN count(ret) > 3 THEN corr(a, a1) END, 9) + 0.0 AS abs_autocorr_1, round(CASE WHEN count(ret) > 7 THEN corr(a, a5) END, 9) + 0.0 AS abs_autocorr_5, round(min(dd), 9) + 0.0 AS max_drawdown
FROM x GROUP BY instrument_id"""
)
def stylized_facts(spark, sf):
    return rounded(D.stylized_facts(V.hourly_bars(spark, sf)))


@register(
    f"""WITH {V.BARS}, p AS (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) AS pc FROM bars), x AS (
  SELECT instrument_id, ln(open / pc) AS o, ln(close / open) AS c, ln(high / low) AS hl, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM p WHERE pc IS NOT NULL
), v AS (
  SELECT instrument_id, count(*) AS n, var_samp(o + c) AS cc, avg(hl * hl) / (4 * ln(2)) AS pk, avg(0.5 * hl * hl - (2 * ln(2) - 1) * c * c) AS gk, var_samp(o) AS vo, var_samp(c) AS vc, avg(rs) AS rs FROM x GROUP BY 1
), k AS (SELECT *, 0.34 / (1.34 + (n + 1.0::DOUBLE) / nullif(n - 1.0::DOUBLE, 0)) AS k FROM v)
SELECT instrument_id, n AS n_periods, round(sqrt(greatest(cc, 0) * 252), 9) + 0.0 AS close_to_close, round(sqrt(greatest(pk, 0) * 252), 9) + 0.0 AS parkinson,
  round(sqrt(greatest(gk, 0) * 252), 9) + 0.0 AS garman_klass, round(sqrt(greatest(vo + k * vc + (1 - k) * rs, 0) * 252), 9) + 0.0 AS yang_zhang FROM k"""
)
def realized_vol(spark, sf):
    return rounded(D.realized_volatility(V.hourly_bars(spark, sf)))


_ACF = (
    V.RETURNS
    + """, numbered AS (SELECT instrument_id, log_ret, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS i FROM returns WHERE log_ret IS NOT NULL
), series AS (
  SELECT instrument_id, 'ret' AS series, i, log_ret AS x FROM numbered UNION ALL SELECT instrument_id, 'abs', i, abs(log_ret) FROM numbered UNION ALL SELECT instrument_id, 'sq', i, log_ret * log_ret FROM numbered
), d AS (SELECT instrument_id, series, i, x - avg(x) OVER w AS d, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY instrument_id, series)
), pairs AS (
  SELECT a.instrument_id, a.series, l.lag, a.n, sum(a.d * b.d) AS top, sum(a.d * a.d) AS den
  FROM d a CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INT) AS lag) l LEFT JOIN d b ON a.instrument_id = b.instrument_id AND a.series = b.series AND b.i = a.i + l.lag GROUP BY ALL
), acfs AS (SELECT instrument_id, series, lag, CASE WHEN n > lag + 1 AND den > 0 THEN top / den END AS acf, 1.96 / sqrt(n) AS band FROM pairs)"""
)


@register(f"WITH {_ACF} SELECT instrument_id, series, lag, {r('acf', 'band')} FROM acfs")
def acf_grid(spark, sf):
    return rounded(D.acf(V.hourly_bars(spark, sf)))


def _pacf_sql(lags: int) -> str:
    """The recursion as one query per lag."""
    steps = ["l1 AS (SELECT *, r1 AS p1_1, 1 - r1 * r1 AS v1 FROM wide)"]
    for k in range(2, lags + 1):
        top = " - ".join([f"r{k}"] + [f"p{k - 1}_{j} * r{k - j}" for j in range(1, k)])
        steps.append(f"m{k} AS (SELECT *, CASE WHEN v{k - 1} > 1e-12 THEN ({top}) / v{k - 1} END AS p{k}_{k} FROM l{k - 1})")
        own = ", ".join(f"p{k - 1}_{j} - p{k}_{k} * p{k - 1}_{k - j} AS p{k}_{j}" for j in range(1, k))
        steps.append(f"l{k} AS (SELECT *, {own}, v{k - 1} * (1 - p{k}_{k} * p{k}_{k}) AS v{k} FROM m{k})")
    wide = ", ".join(f"max(acf) FILTER (lag = {k}) AS r{k}" for k in range(1, lags + 1))
    tall = " UNION ALL ".join(f"SELECT instrument_id, series, {k} AS lag, round(p{k}_{k}, 9) + 0.0 AS pacf FROM l{lags}" for k in range(1, lags + 1))
    return f"WITH {_ACF}, wide AS (SELECT instrument_id, series, {wide} FROM acfs WHERE series <> 'sq' GROUP BY ALL), {', '.join(steps)} {tall}"


@register(_pacf_sql(5))
def pacf_grid(spark, sf):
    return rounded(D.pacf(V.hourly_bars(spark, sf)))


_JUMPS = (
    V.BARS
    + """, numbered AS (SELECT *, row_number() OVER w - 1 AS source_row, ln(close) - ln(lag(close) OVER w) AS log_ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
), rets AS (SELECT instrument_id, ts, source_row, log_ret FROM numbered WHERE log_ret IS NOT NULL
), m AS (SELECT instrument_id, median(log_ret) AS med, avg(log_ret) AS mean, stddev_samp(log_ret) AS sd FROM rets GROUP BY 1
), mads AS (SELECT instrument_id, median(abs(log_ret - med)) AS mad FROM rets JOIN m USING (instrument_id) GROUP BY 1
), scored AS (
  SELECT r.*, CASE WHEN mad > 0 THEN (log_ret - med) / (1.4826 * mad) WHEN sd > 0 THEN (log_ret - mean) / sd END AS z FROM rets r JOIN m USING (instrument_id) JOIN mads USING (instrument_id)
)"""
)


@register(f"WITH {_JUMPS} SELECT instrument_id, ts, source_row, {r('log_ret', 'z')}, coalesce(abs(z) > 3, false) AS is_jump FROM scored")
def jump_scores(spark, sf):
    return rounded(D.jump_scores(V.hourly_bars(spark, sf)))


@register(
    f"""WITH {_JUMPS}, x AS (SELECT *, abs(lag(log_ret) OVER (PARTITION BY instrument_id ORDER BY ts)) AS b FROM scored
), v AS (
  SELECT instrument_id, count(*) AS n_returns, count(*) FILTER (abs(z) > 3) AS n_jumps, coalesce(string_agg(CAST(source_row AS VARCHAR), ',' ORDER BY source_row) FILTER (abs(z) > 3), '') AS jump_rows,
    sum(log_ret * log_ret) AS rv, {math.pi / 2!r} * coalesce(sum(abs(log_ret) * b), 0) AS bv FROM x GROUP BY 1
), p AS (SELECT instrument_id, avg(ln(high / low) * ln(high / low)) / (4 * ln(2)) AS pk FROM bars GROUP BY 1)
SELECT instrument_id, n_returns, n_jumps, jump_rows, round(rv, 9) + 0.0 AS realized_variance, round(bv, 9) + 0.0 AS bipower_variation,
  round(greatest(rv - bv, 0), 9) + 0.0 AS excess_variation, round(greatest(rv - pk, 0), 9) + 0.0 AS range_excess FROM v JOIN p USING (instrument_id)"""
)
def jump_summary(spark, sf):
    return rounded(D.jump_summary(V.hourly_bars(spark, sf)))


def _dfa_sql(source: str, order: int = 1) -> str:
    """CTEs up to ``f2``, the mean squared residual of every segment; ``source`` gives (instrument_id, i, x)."""
    scales = ", ".join(f"({s})" for s in M.SCALES)
    gram = ("x", "(x * x - (scale * scale - 1) / 12.0::DOUBLE)", "(x * x * x - x * (3 * scale * scale - 7) / 20.0::DOUBLE)")[:order]
    rest = " - ".join(["var_pop(y) * count(*)"] + [f"sum(y * {p}) * sum(y * {p}) / sum({p} * {p})" for p in gram])
    return f"""{source}, cnt AS (SELECT *, count(*) OVER (PARTITION BY instrument_id) AS n, avg(x) OVER (PARTITION BY instrument_id) AS mean FROM src
), prof AS (SELECT instrument_id, i, n, sum(x - mean) OVER (PARTITION BY instrument_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM cnt
), cut AS (SELECT p.*, scale, n - n % scale AS used FROM prof p CROSS JOIN (VALUES {scales}) s(scale) WHERE scale <= n // 4
), seg AS (
  SELECT instrument_id, n, scale, 'front' AS side, i // scale AS segment, i % scale AS k, y FROM cut WHERE i < used
  UNION ALL SELECT instrument_id, n, scale, 'back', (i - n + used) // scale, (i - n + used) % scale, y FROM cut WHERE i - n + used >= 0
), gram AS (SELECT *, k - (scale - 1) / 2.0::DOUBLE AS x FROM seg
), f2 AS (SELECT * FROM (SELECT instrument_id, n, scale, side, segment, ({rest}) / any_value(scale) AS f2 FROM gram GROUP BY instrument_id, n, scale, side, segment) WHERE f2 > 0)"""


_SRC = V.RETURNS + ", src AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, log_ret AS x FROM returns WHERE log_ret IS NOT NULL)"
_MIXED = (
    V.RETURNS
    + """, plain AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, log_ret AS x FROM returns WHERE log_ret IS NOT NULL
), src AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY md5('20260918|' || i)) - 1 AS i, x FROM plain)"""
)
_FQ = """, fq AS (
  SELECT instrument_id, n, scale, q, CASE WHEN q = 0 THEN exp(0.5 * avg(ln(f2))) ELSE pow(avg(pow(f2, q / 2.0)), 1.0 / nullif(q, 0)) END AS f
  FROM f2 CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) v(q) GROUP BY instrument_id, n, scale, q
), hq AS (SELECT instrument_id, q, regr_slope(ln(f), ln(scale)) AS h, regr_r2(ln(f), ln(scale)) AS r2, count(*) AS scales_used FROM fq WHERE n >= 96 GROUP BY instrument_id, q HAVING count(*) >= 4)"""


@register(f"WITH {_dfa_sql(_SRC)} SELECT instrument_id, n, scale, 2 AS q, round(sqrt(avg(f2)), 9) + 0.0 AS f FROM f2 GROUP BY ALL")
def dfa_fluctuation(spark, sf):
    return rounded(M.fluctuation(D.returns(V.hourly_bars(spark, sf))))


@register(f"WITH {_dfa_sql(_SRC)}{_FQ} SELECT instrument_id, {r('h', 'r2')}, scales_used FROM hq WHERE q = 2")
def dfa_hurst(spark, sf):
    return rounded(M.dfa_hurst(D.returns(V.hourly_bars(spark, sf))))


@register(f"WITH {_dfa_sql(_SRC, 0)}{_FQ} SELECT instrument_id, {r('h', 'r2')}, scales_used FROM hq WHERE q = 2")
def dfa_hurst_order0(spark, sf):
    return rounded(M.dfa_hurst(D.returns(V.hourly_bars(spark, sf)), 0))


@register(f"WITH {_dfa_sql(_SRC, 2)}{_FQ} SELECT instrument_id, {r('h', 'r2')}, scales_used FROM hq WHERE q = 2")
def dfa_hurst_order2(spark, sf):
    return rounded(M.dfa_hurst(D.returns(V.hourly_bars(spark, sf)), 2))


@register(f"WITH {_dfa_sql(_SRC, 3)}{_FQ} SELECT instrument_id, {r('h', 'r2')}, scales_used FROM hq WHERE q = 2")
def dfa_hurst_order3(spark, sf):
    return rounded(M.dfa_hurst(D.returns(V.hourly_bars(spark, sf)), 3))


@register(f"WITH {_dfa_sql(_SRC)}{_FQ} SELECT instrument_id, q, {r('h', 'r2')}, scales_used FROM hq")
def mfdfa_hurst(spark, sf):
    return rounded(M.scaling(D.returns(V.hourly_bars(spark, sf))))


@register(f"WITH {_dfa_sql(_SRC)}{_FQ} SELECT instrument_id, round(max(h) FILTER (q = -2) - max(h) FILTER (q = 2), 9) + 0.0 AS width FROM hq GROUP BY 1")
def mfdfa_width(spark, sf):
    return rounded(M.mfdfa_width(D.returns(V.hourly_bars(spark, sf))))


@register(f"WITH {_dfa_sql(_MIXED)}{_FQ} SELECT instrument_id, {r('h', 'r2')}, scales_used FROM hq WHERE q = 2")
def surrogate_hurst(spark, sf):
    return rounded(M.dfa_hurst(M.surrogate(D.returns(V.hourly_bars(spark, sf)))))


_BLOCKS = (
    V.RETURNS
    + """, plain AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS i, log_ret AS x FROM returns WHERE log_ret IS NOT NULL
), sizes AS (SELECT instrument_id, count(*) AS n, greatest(4, CAST(round(sqrt(count(*))) AS BIGINT)) AS b FROM plain GROUP BY 1
), reps AS (SELECT *, unnest(range(100)) AS rep FROM sizes WHERE n >= b
), blocks AS (SELECT *, unnest(range(CAST(ceil(n / b) AS BIGINT))) AS block FROM reps
), starts AS (SELECT *, CAST('0x' || substr(md5('20260918|' || rep || '|' || block), 1, 8) AS BIGINT) % (n - b + 1) AS start FROM blocks
), src AS (
  SELECT s.instrument_id || '|' || rep AS instrument_id, block * b + p.i - start AS i, x
  FROM starts s JOIN plain p ON s.instrument_id = p.instrument_id AND p.i BETWEEN start AND start + b - 1 WHERE block * b + p.i - start < n
)"""
)


@register(
    f"""WITH {_dfa_sql(_BLOCKS)}{_FQ}, hs AS (SELECT split_part(instrument_id, '|', 1) AS instrument_id, h FROM hq WHERE q = 2)
SELECT z.instrument_id, count(h) AS valid, round(CASE WHEN count(h) >= 25 THEN quantile_cont(h, 0.025) END, 9) + 0.0 AS low, round(CASE WHEN count(h) >= 25 THEN quantile_cont(h, 0.975) END, 9) + 0.0 AS high
FROM (SELECT DISTINCT instrument_id FROM plain) z LEFT JOIN hs ON z.instrument_id = hs.instrument_id GROUP BY 1"""
)
def bootstrap_hurst(spark, sf):
    return rounded(M.bootstrap_hurst(D.returns(V.hourly_bars(spark, sf))))


# --- regimes and joint study ------------------------------------------------

_REGIMES = (
    _VOL
    + """, cuts AS (SELECT instrument_id, quantile_cont(vol, 1::DOUBLE / 3) AS q1, quantile_cont(vol, 2::DOUBLE / 3) AS q2 FROM vols GROUP BY 1
), regimes AS (
  SELECT instrument_id, ts, log_ret, vol, CASE WHEN vol <= q1 THEN 'LOW_VOL' WHEN vol <= q2 THEN 'MID_VOL' ELSE 'HIGH_VOL' END || '_' || CASE WHEN log_ret > 0 THEN 'UP' WHEN log_ret < 0 THEN 'DOWN' ELSE 'FLAT' END AS regime
  FROM vols JOIN cuts USING (instrument_id) WHERE q1 < q2
)"""
)


@register(f"WITH {_REGIMES} SELECT instrument_id, ts, {r('log_ret', 'vol')}, regime FROM regimes")
def regime_labels(spark, sf):
    return rounded(regimes.labels(V.hourly_bars(spark, sf)))


@register(
    f"""WITH {_REGIMES} SELECT instrument_id, regime, count(*) AS n, round(avg(log_ret), 9) + 0.0 AS mean_return, round(avg(abs(log_ret)), 9) + 0.0 AS mean_abs_return,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY instrument_id) AS DOUBLE), 9) + 0.0 AS fraction FROM regimes GROUP BY 1, 2"""
)
def regime_stats(spark, sf):
    return rounded(regimes.stats(regimes.labels(V.hourly_bars(spark, sf))))


@register(
    f"""WITH {_REGIMES}, t AS (SELECT instrument_id, regime AS from_regime, lead(regime) OVER (PARTITION BY instrument_id ORDER BY ts) AS to_regime FROM regimes)
SELECT *, count(*) AS n FROM t WHERE to_regime IS NOT NULL GROUP BY ALL"""
)
def regime_transitions(spark, sf):
    return regimes.transitions(regimes.labels(V.hourly_bars(spark, sf)))


@register(
    f"""WITH {_REGIMES}, c AS (SELECT *, CASE WHEN regime = lag(regime) OVER w THEN 0 ELSE 1 END AS new FROM regimes WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
), i AS (SELECT *, sum(new) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c), e AS (SELECT instrument_id, regime, run, count(*) AS length FROM i GROUP BY ALL)
SELECT instrument_id, regime, count(*) AS runs, round(avg(length), 9) + 0.0 AS mean_length, max(length) AS max_length FROM e GROUP BY 1, 2"""
)
def regime_runs(spark, sf):
    return rounded(regimes.runs(regimes.labels(V.hourly_bars(spark, sf))))


_INDEX = "error"
_ALIGNED = (
    V.BARS
    + f""", u AS (
  SELECT *, close / lag(close) OVER w - 1 AS ret, (high - low) / open AS range_pct FROM bars WHERE instrument_id <> '{_INDEX}' WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
), uv AS (
  SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol20 FROM u WINDOW w AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING)
), j AS (SELECT uv.*, x.close AS vix_close, abs(ret) AS abs_ret FROM uv JOIN bars x ON x.instrument_id = '{_INDEX}' AND x.ts = uv.ts
), aligned AS (
  SELECT instrument_id, ts, ret, abs_ret, range_pct, vol20, vix_close, vix_close / lag(vix_close) OVER w - 1 AS vix_change, lead(ret) OVER w AS next_ret, lead(abs_ret) OVER w AS next_abs_ret
  FROM j WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
)"""
)
_THIRDS = (
    _ALIGNED
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY vix_close, ts) AS rn, count(*) OVER (PARTITION BY instrument_id) AS n FROM aligned
), thirds AS (SELECT *, CASE WHEN rn <= (n + 1) // 3 THEN 'LOW' WHEN rn <= (2 * n) // 3 THEN 'MID' ELSE 'HIGH' END AS tercile FROM ranked)"""
)


def _aligned(spark, sf):
    bars = V.hourly_bars(spark, sf)
    return X.align(bars.where(F.col("instrument_id") != _INDEX), bars.where(F.col("instrument_id") == _INDEX))


@register(f"WITH {_ALIGNED} SELECT instrument_id, ts, {r('ret', 'abs_ret', 'range_pct', 'vol20', 'vix_close', 'vix_change', 'next_ret', 'next_abs_ret')} FROM aligned")
def series_join(spark, sf):
    return rounded(_aligned(spark, sf))


@register(f"WITH {_THIRDS} SELECT instrument_id, ts, vix_close, tercile FROM thirds")
def vix_terciles(spark, sf):
    return X.terciles(_aligned(spark, sf)).select("instrument_id", "ts", "vix_close", "tercile")


@register(
    f"""WITH {_THIRDS} SELECT instrument_id, tercile, count(*) AS n, round(avg(abs_ret), 9) + 0.0 AS mean_abs_ret, round(avg(range_pct), 9) + 0.0 AS mean_range_pct,
  round(avg(vol20), 9) + 0.0 AS mean_vol20, round(avg(next_abs_ret), 9) + 0.0 AS mean_next_abs_ret FROM thirds GROUP BY 1, 2"""
)
def tercile_conditionals(spark, sf):
    return rounded(X.conditional_means(X.terciles(_aligned(spark, sf))))


@register(
    f"""WITH {_ALIGNED}, tall AS (
  {" UNION ALL ".join(f"SELECT instrument_id, '{a}~{b}' AS pair, {a} AS x, {b} AS y FROM aligned WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in X.PAIRS)}
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY instrument_id, pair ORDER BY x) + (count(*) OVER (PARTITION BY instrument_id, pair, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY instrument_id, pair ORDER BY y) + (count(*) OVER (PARTITION BY instrument_id, pair, y) - 1) / 2.0::DOUBLE AS ry FROM tall
)
SELECT instrument_id, pair, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN corr(x, y) END, 9) + 0.0 AS pearson, round(CASE WHEN count(*) >= 20 THEN corr(rx, ry) END, 9) + 0.0 AS spearman FROM ranked GROUP BY 1, 2"""
)
def correlation_pairs(spark, sf):
    return rounded(X.correlations(_aligned(spark, sf)))


# --- point in time ----------------------------------------------------------

_MATCHED = f"""WITH {V.MASTER}, {V.OBSERVATIONS}, counted AS (
  SELECT o.record_index, o.contract_id, o.ts, count(m.contract_id) AS matches, any_value(m.effective_from) AS effective_from, any_value(m.effective_to) AS effective_to, any_value(m.lot_size) AS lot_size
  FROM observations o LEFT JOIN master m ON o.contract_id = m.contract_id AND m.effective_from <= o.ts AND (m.effective_to IS NULL OR o.ts <= m.effective_to) AND m.available_at <= TIMESTAMP '1998-06-01'
  GROUP BY ALL
)"""


def _matched(spark, sf):
    return pit.match_master(V.observations(spark, sf), V.contract_master(spark, sf), F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))


@register(f"{_MATCHED} SELECT record_index, contract_id, ts, effective_from, effective_to, lot_size FROM counted WHERE matches = 1")
def pit_enriched(spark, sf):
    return _matched(spark, sf).where("match_status = 'ENRICHED'").select("record_index", "contract_id", "ts", "effective_from", "effective_to", "lot_size")


@register(f"{_MATCHED} SELECT record_index, matches, CASE WHEN matches = 0 THEN 'CONTRACT_MASTER_NOT_FOUND' ELSE 'CONTRACT_MASTER_AMBIGUOUS' END AS match_status FROM counted WHERE matches <> 1")
def pit_exclusions(spark, sf):
    return _matched(spark, sf).where("match_status != 'ENRICHED'").select("record_index", "matches", "match_status")


@register(f"WITH {V.MASTER} SELECT contract_id, effective_from, lot_size FROM master WHERE available_at <= TIMESTAMP '1995-06-01'")
def pit_filter(spark, sf):
    return pit.available(V.contract_master(spark, sf), F.lit("1995-06-01").cast("timestamp_ntz")).select("contract_id", "effective_from", "lot_size")


@register(
    f"""WITH {V.MASTER}, n AS (SELECT *, lead(effective_from) OVER (PARTITION BY contract_id ORDER BY effective_from, effective_to) AS next_from FROM master)
SELECT contract_id, effective_from, effective_to, next_from FROM n WHERE next_from IS NOT NULL AND (effective_to IS NULL OR next_from <= effective_to)"""
)
def interval_overlap(spark, sf):
    return pit.overlapping_intervals(V.contract_master(spark, sf))


# --- quality and reconciliation ---------------------------------------------


def _judged(spark, sf):
    return quality.reasons(V.quality_rows(spark, sf), F.lit(V.DECISION).cast("timestamp"), V.ROW_ORDER)


@register(f"WITH {V.JUDGED} SELECT l_orderkey, l_linenumber, array_to_string(reasons, ',') AS reasons FROM judged")
def quality_rows(spark, sf):
    return _judged(spark, sf).select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


@register(f"WITH {V.JUDGED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY 1")
def quality_reasons(spark, sf):
    return quality.reason_counts(_judged(spark, sf))


@register(
    f"""WITH {V.JUDGED} SELECT count(*) AS n_rows, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS excluded,
  CASE WHEN count(*) FILTER (len(reasons) > 0) > 0 THEN 'REJECT_ROWS' ELSE 'PASS' END AS status FROM judged"""
)
def quality_report(spark, sf):
    return quality.report(_judged(spark, sf))


_NEGATIVE = "coalesce(least(open, high, low, close, last_price, settlement) < 0, false)"
_CHECKS = {
    "rows": ("count(*)", False),
    "non_option_type": ("count(*) FILTER (option_type IS NULL OR option_type NOT IN ('CE', 'PE'))", True),
    "missing_trade_date": ("count(*) FILTER (trade_date IS NULL)", True),
    "missing_expiry": ("count(*) FILTER (expiry IS NULL)", True),
    "nonpositive_strike": ("count(*) FILTER (strike <= 0)", True),
    "expiry_before_trade": ("count(*) FILTER (expiry < trade_date)", True),
    "negative_prices": (f"count(*) FILTER ({_NEGATIVE})", True),
    "negative_volume": ("count(*) FILTER (volume < 0)", True),
    "negative_open_interest": ("count(*) FILTER (open_interest < 0)", True),
    "negative_lot_size": ("count(*) FILTER (lot_size < 0)", True),
    "zero_volume_rows": ("count(*) FILTER (volume = 0)", False),
    "zero_oi_rows": ("count(*) FILTER (open_interest = 0)", False),
    "missing_underlying": ("count(*) FILTER (underlying_price IS NULL)", False),
    "missing_lot_size": ("count(*) FILTER (lot_size IS NULL)", False),
    "ce_rows": ("count(*) FILTER (option_type = 'CE')", False),
    "pe_rows": ("count(*) FILTER (option_type = 'PE')", False),
    "unique_expiries": ("count(DISTINCT expiry)", False),
    "unique_trade_dates": ("count(DISTINCT trade_date)", False),
    "duplicate_contract_keys": ("(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM panel GROUP BY trade_date, expiry, strike, option_type))", True),
    "files": ("count(DISTINCT trade_date)", False),
    "file_errors": ("(SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'P')", True),
}
_CHECK_SQL = f"WITH {V.PANEL}, checks AS ({' UNION '.join(f'''SELECT '{n}' AS "check", {e} AS value, {str(h).lower()} AS hard FROM panel''' for n, (e, h) in _CHECKS.items())})"


def _bad_files(spark, sf):
    return V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("file")).distinct()


def _snapshot(spark, sf):
    """Every day's rows count as one file; some files could not be read."""
    panel = V.option_panel(spark, sf)
    return quality.snapshot_checks(panel, panel.select("trade_date").distinct(), _bad_files(spark, sf))


@register(f"{_CHECK_SQL} SELECT *, hard AND value > 0 AS failed FROM checks")
def snapshot_checks(spark, sf):
    return _snapshot(spark, sf)


@register(f"{_CHECK_SQL} SELECT count(*) FILTER (hard AND value > 0) AS hard_failures, CASE WHEN count(*) FILTER (hard AND value > 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM checks")
def snapshot_status(spark, sf):
    return quality.status(_snapshot(spark, sf))


def _days(spark, sf, name, column):
    return V.table(spark, sf, name).select(F.to_date(column).alias("day"))


@register(
    """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT CAST(day AS VARCHAR) AS day, 'left_only' AS side FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT CAST(day AS VARCHAR), 'right_only' FROM b WHERE day NOT IN (SELECT day FROM a)"""
)
def recon_dates(spark, sf):
    return reconcile.date_differences(_days(spark, sf, "orders", "o_orderdate"), _days(spark, sf, "lineitem", "l_shipdate")).withColumn("day", F.col("day").cast("string"))


@register(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT CAST(day AS VARCHAR) AS day FROM e WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM d)"""
)
def calendar_gaps(spark, sf):
    return reconcile.weekday_gaps(_days(spark, sf, "orders", "o_orderdate")).withColumn("day", F.col("day").cast("string"))


@register(
    f"""WITH {V.PANEL} SELECT CASE WHEN trade_date >= DATE '1998-07-08' THEN 'udiff' ELSE 'legacy' END AS route, count(*) AS n,
  {", ".join(f"round(100 * avg(CAST({c} IS NULL AS INT)), 9) + 0.0 AS {c}_missing_pct" for c in ("last_price", "underlying_price", "lot_size"))} FROM panel GROUP BY 1"""
)
def recon_missingness(spark, sf):
    return rounded(reconcile.missing_by_route(V.option_panel(spark, sf), ["last_price", "underlying_price", "lot_size"], "1998-07-08"))


@register("SELECT CASE WHEN o_orderdate >= DATE '1998-07-08' THEN 'udiff' ELSE 'legacy' END AS route, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def recon_routes(spark, sf):
    rows = V.table(spark, sf, "orders").select(P.route(F.to_date("o_orderdate"), "1998-07-08").alias("route"), F.col("o_orderstatus").alias("status"))
    return rows.groupBy("route", "status").agg(F.count("*").alias("n"))


_PCT = {f"{side}_missing_{name}_pct": f"100 * avg(CAST({field} IS NULL AS INT)) FILTER (trade_date {op} DATE '1998-07-08')" for name, field in (("last_price", "last_price"), ("underlying", "underlying_price"), ("lot_size", "lot_size")) for side, op in (("legacy", "<"), ("udiff", ">="))}
_PANEL_CHECKS = {
    "normalized_rows": "count(*)",
    "normalized_trade_dates": "count(DISTINCT trade_date)",
    "legacy_rows": "count(*) FILTER (trade_date < DATE '1998-07-08')",
    "udiff_rows": "count(*) FILTER (trade_date >= DATE '1998-07-08')",
    **_PCT,
    "zero_volume_rows": "count(*) FILTER (volume = 0)",
    "zero_open_interest_rows": "count(*) FILTER (open_interest = 0)",
    "ce_rows": "count(*) FILTER (option_type = 'CE')",
    "pe_rows": "count(*) FILTER (option_type = 'PE')",
    "unique_expiries": "count(DISTINCT expiry)",
    "negative_price_rows": f"count(*) FILTER ({_NEGATIVE})",
    "expiry_before_trade": "count(*) FILTER (expiry < trade_date)",
    "nonpositive_strike": "count(*) FILTER (strike <= 0)",
    "duplicate_contract_keys": _CHECKS["duplicate_contract_keys"][0],
    "normalized_files": "count(DISTINCT trade_date)",
    "file_errors": _CHECKS["file_errors"][0],
}
_RECORD_CHECKS = {
    "manifest_records": "count(*)",
    "validated_days_from_manifests": "count(DISTINCT day) FILTER (status = 'VALIDATED')",
    "route_errors": "count(*) FILTER (route <> CASE WHEN day >= DATE '1998-07-08' THEN 'udiff' ELSE 'legacy' END)",
    "weekday_no_archive_count": "count(*) FILTER (status = 'NO_ARCHIVE' AND isodow(day) < 6)",
}
_YEARS = range(1993, 2000)
_EXPECTED = ", ".join(map(str, _YEARS))
_LIST_CHECKS = {  # each gives the values of a list
    "boundary_trade_dates": "SELECT trade_date AS v FROM panel WHERE trade_date BETWEEN DATE '1998-07-01' AND DATE '1998-07-15'",
    "weekday_no_archive_days": "SELECT day AS v FROM records WHERE status = 'NO_ARCHIVE' AND isodow(day) < 6",
    "missing_normalized_dates": "SELECT day AS v FROM records WHERE status = 'VALIDATED' AND day NOT IN (SELECT trade_date FROM panel)",
    "unexpected_normalized_dates": "SELECT trade_date AS v FROM panel WHERE trade_date NOT IN (SELECT day FROM records WHERE status = 'VALIDATED')",
    "expected_years": f"SELECT unnest([{_EXPECTED}]) AS v",
    "years_found": "SELECT year(day) AS v FROM records",
    "missing_year_manifests": f"SELECT v FROM (SELECT unnest([{_EXPECTED}]) AS v) WHERE v NOT IN (SELECT year(day) FROM records)",
    "unexpected_year_manifests": f"SELECT year(day) AS v FROM records WHERE year(day) NOT IN ({_EXPECTED})",
}
_HISTORY_SQL = f"""WITH {V.PANEL}, records AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'NO_ARCHIVE' END AS status,
    CASE WHEN o_orderdate >= DATE '1998-07-08' AND o_orderstatus <> 'P' THEN 'udiff' ELSE 'legacy' END AS route, o_orderpriority AS source_tier FROM orders
), checks AS (
  {" UNION ".join(f"SELECT '{n}' AS check_name, CAST({e} AS DOUBLE) AS value, NULL AS detail FROM panel" for n, e in _PANEL_CHECKS.items())}
  UNION {" UNION ".join(f"SELECT '{n}', CAST({e} AS DOUBLE), NULL FROM records" for n, e in _RECORD_CHECKS.items())}
  UNION {" UNION ".join(f"SELECT '{n}', CAST(count(DISTINCT v) AS DOUBLE), coalesce(string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)), '') FROM ({e})" for n, e in _LIST_CHECKS.items())}
  UNION SELECT 'manifest_count', CAST(count(DISTINCT year(day)) AS DOUBLE), NULL FROM records
  UNION SELECT 'status_counts', CAST(count(*) AS DOUBLE), string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(status, 'MISSING') AS k, count(*) AS n FROM records GROUP BY 1)
  UNION SELECT 'source_tiers', CAST(count(*) AS DOUBLE), string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(CAST(source_tier AS VARCHAR), 'missing') AS k, count(*) AS n FROM records GROUP BY 1)
)
SELECT check_name AS "check", round(value, 9) + 0.0 AS value, detail, check_name IN {reconcile.HARD} AS hard, check_name IN {reconcile.HARD} AND coalesce(value, 0) > 0 AS failed FROM checks"""


@register(_HISTORY_SQL)
def historical_checks(spark, sf):
    panel, day = V.option_panel(spark, sf), F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "NO_ARCHIVE")
    told = F.when(F.col("o_orderstatus") != "P", P.route(day, "1998-07-08")).otherwise("legacy")
    records = V.table(spark, sf, "orders").select(day.alias("day"), status.alias("status"), told.alias("route"), F.col("o_orderpriority").alias("source_tier"))
    manifests = records.select(F.year("day").alias("year")).distinct()
    return rounded(reconcile.historical_checks(panel, records, manifests, panel.select("trade_date").distinct(), _bad_files(spark, sf), list(_YEARS), "1998-07-08", "1998-07-01", "1998-07-15"))


# --- parsing and projections ------------------------------------------------


@register(
    """SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS parsed, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS tolerant,
  TRY_CAST(o_orderpriority AS DOUBLE) AS coerced FROM orders"""
)
def normalize_numbers(spark, sf):
    x = V.table(spark, sf, "orders")
    said = F.concat(F.lit(" "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" "))
    gap = F.when(F.col("o_orderstatus") == "F", F.lit(" N/A ")).otherwise(F.col("o_orderkey").cast("string"))
    return x.select("o_orderkey", P.parse_number(said).alias("parsed"), P.parse_number(gap).alias("tolerant"), P.coerce_number(F.col("o_orderpriority")).alias("coerced"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS TIMESTAMP) END AS day FROM orders")
def normalize_dates(spark, sf):
    x, d = V.table(spark, sf, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.date_format(d, "dd-MMM-yyyy")).when(k == 1, F.date_format(d, "d-M-yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "dd/MM/yyyy")).otherwise("no day")
    return x.select("o_orderkey", P.parse_date(said).cast("timestamp_ntz").alias("day"))


@register("SELECT p_partkey, upper(p_brand) || '|' || CAST(DATE '2026-01-01' + p_size AS VARCHAR) || '|CE|' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 0.5 AS VARCHAR) END AS instrument_id FROM part")
def instrument_ids(spark, sf):
    strike = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + F.lit(0.5).cast("double"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))
    return V.table(spark, sf, "part").select("p_partkey", P.instrument_id(F.upper("p_brand"), day, F.lit("CE"), strike).alias("instrument_id"))


@register("SELECT n_name, substr(sha256(n_name || '|' || n_regionkey), 1, 16) AS id FROM nation")
def content_ids(spark, sf):
    return V.table(spark, sf, "nation").select("n_name", F.substring(F.sha2(F.concat_ws("|", "n_name", "n_regionkey"), 256), 1, 16).alias("id"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view')")
def json_fields(spark, sf):
    rows = V.table(spark, sf, "events").where(F.upper("event_type").isin("CLICK", "VIEW"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def sample_top(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


# --- evaluation -------------------------------------------------------------


@register(
    """WITH s AS (SELECT o_orderkey, o_orderdate AS ts, o_orderdate + INTERVAL 5 DAY AS label_end, epoch(o_orderdate) AS e FROM orders), m AS (SELECT min(e) AS a, max(e) AS b FROM s
), f AS (SELECT s.*, CAST(least(floor((e - a) / (b - a) * 5), 4) AS INT) AS fold FROM s, m), span AS (SELECT fold AS test_fold, min(ts) AS t0, max(label_end) AS t1 FROM f GROUP BY 1)
SELECT test_fold, f.fold, count(*) AS n FROM f JOIN span ON f.fold <> test_fold AND NOT (f.ts <= t1 + INTERVAL 1 DAY AND f.label_end >= t0) GROUP BY 1, 2"""
)
def purged_folds(spark, sf):
    s = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("label_end"))
    return validation.purged_training(s, 5, embargo_seconds=86_400).groupBy("test_fold", "fold").agg(F.count("*").alias("n"))


_SMALL = V.RETURNS + ", rr AS (SELECT instrument_id, ts, ret / 100 AS r FROM returns WHERE ret IS NOT NULL AND ret / 100 > -1)"


def _small(spark, sf):
    return D.returns(V.hourly_bars(spark, sf)).withColumn("ret", F.col("ret") / 100)


@register(
    f"""WITH {_SMALL}, w AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS wealth FROM rr
), d AS (SELECT *, least(wealth / max(wealth) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, wealth - 1) AS dd FROM w)
SELECT instrument_id, count(*) AS n, round(avg(r) * 252, 9) + 0.0 AS annual_return, round(stddev_samp(r) * sqrt(252), 9) + 0.0 AS annual_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 9) + 0.0 AS sharpe,
  round(avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252), 9) + 0.0 AS sortino, round(avg(ln(1 + r)), 9) + 0.0 AS mean_log_growth, round(min(dd), 9) + 0.0 AS max_drawdown, round(quantile_cont(r, 0.05), 9) + 0.0 AS tail_5
FROM d GROUP BY 1"""
)
def path_metrics(spark, sf):
    return rounded(validation.path_metrics(_small(spark, sf)))


@register(
    f"""WITH {V.RETURNS}, a AS (SELECT instrument_id, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM returns GROUP BY 1
), t AS (SELECT coalesce(stddev_samp(sharpe), 0) * sqrt(2 * ln(greatest(count(sharpe), 2))) AS expected_max FROM a)
SELECT instrument_id, n, round(sharpe, 9) + 0.0 AS sharpe, round(expected_max, 9) + 0.0 AS expected_max,
  round((sharpe - expected_max) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe, 1e-12)), 9) + 0.0 AS z FROM a, t"""
)
def deflated_sharpe(spark, sf):
    return rounded(validation.deflated_sharpe(D.returns(V.hourly_bars(spark, sf))))


@register("SELECT o_orderkey, round(abs(o_totalprice) * 0.001 + 2, 6) AS cost, round(o_totalprice * 0.01 - (abs(o_totalprice) * 0.001 + 2), 6) AS net FROM orders")
def net_of_costs(spark, sf):
    t = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("notional"), (F.col("o_totalprice") * 0.01).alias("gross"))
    return validation.net_of_costs(t, 0.001, 2.0).select("o_orderkey", F.round("cost", 6).alias("cost"), F.round("net", 6).alias("net"))


@register(
    f"""WITH {_VOL}, x AS (SELECT instrument_id, vol * vol - log_ret * log_ret AS vrp FROM vols)
SELECT instrument_id, count(*) AS n, round(avg(vrp), 9) + 0.0 AS mean_vrp, round(median(vrp), 9) + 0.0 AS median_vrp, round(quantile_cont(vrp, 0.25), 9) + 0.0 AS q25, round(quantile_cont(vrp, 0.75), 9) + 0.0 AS q75,
  round(avg(CAST(vrp > 0 AS INT)), 9) + 0.0 AS positive_share FROM x GROUP BY 1"""
)
def variance_premium(spark, sf):
    bars = V.hourly_bars(spark, sf)
    implied = D.rolling_vol(bars).select("instrument_id", "ts", (F.col("vol") * F.col("vol")).alias("implied_var"))
    realized = D.returns(bars).select("instrument_id", "ts", (F.col("log_ret") * F.col("log_ret")).alias("realized_var"))
    return rounded(validation.variance_premium(implied, realized))


@register(
    """WITH q AS (SELECT event_type AS instrument_id, ts, event_id, value AS bid, value + (event_id % 5) - 1 AS ask, value + 0.5 AS mid, user_id - 2 AS bs, user_id AS sz, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap FROM events)
SELECT instrument_id, count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (mid < bid OR mid > ask) AS mid_outside, count(*) FILTER (bs <= 0 OR sz <= 0) AS bad_size, count(*) FILTER (bid < 0 OR ask < 0) AS negative, count(*) FILTER (gap > 3600) AS stale FROM q GROUP BY 1"""
)
def quote_hygiene(spark, sf):
    v = F.col("value")
    q = V.table(spark, sf, "events").select(F.col("event_type").alias("instrument_id"), "ts", F.col("event_id").alias("event_sequence"), v.alias("bid"), (v + F.col("event_id") % 5 - 1).alias("ask"), (v + 0.5).alias("mid"), (F.col("user_id") - 2).alias("bid_size"), F.col("user_id").alias("ask_size"))
    return quality.quote_hygiene(q)


@register("SELECT l_returnflag AS status, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY 1")
def status_counts(spark, sf):
    """Group counts with their share: the share is a window over a handful of groups."""
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


from strikeline.plans import researched, sourced  # noqa: E402, F401  (their queries register themselves here)
