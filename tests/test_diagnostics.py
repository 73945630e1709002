"""Diagnostics against plain numpy, and their edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeline.operators import bars as B
from strikeline.operators import diagnostics as D
from strikeline.operators import discovery as X
from strikeline.operators import memory as M
from strikeline.operators import regimes, validation
from strikeline.streaming import sessions

T0 = dt.datetime(2026, 9, 18, 3, 45)


def series(spark, close, name="a"):
    rows = [(name, T0 + dt.timedelta(minutes=i), float(c), float(c) + 1, float(c) - 0.5, float(c)) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "instrument_id string, ts timestamp, open double, high double, low double, close double")


def walk(n, seed=12345):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


def test_facts(spark):
    close = walk(128)
    f = D.stylized_facts(series(spark, close)).first()
    r = pd.Series(close).pct_change().dropna()
    a = r.abs()
    assert (f.n_rows, f.n_returns) == (128, 127)
    want = [r.mean(), r.std(), r.skew(), r.kurt(), a.autocorr(1), a.autocorr(5), (close / np.maximum.accumulate(close) - 1).min()]
    assert np.allclose([f.mean_return, f.sd_return, f.skewness, f.excess_kurtosis, f.abs_autocorr_1, f.abs_autocorr_5, f.max_drawdown], want)


@pytest.mark.parametrize("close", [[100], [100, 101], [100] * 30])
def test_degenerate_series(spark, close):
    s = series(spark, close)
    for op in (D.stylized_facts, D.realized_volatility, D.acf, D.pacf, D.jump_summary, D.rolling_vol_summary, regimes.labels):
        op(s).collect()
    assert M.dfa_hurst(D.returns(s)).collect() == []


def test_acf_and_pacf(spark):
    close = walk(200)
    x = np.diff(np.log(close))
    d = x - x.mean()
    got = {r.lag: r.acf for r in D.acf(series(spark, close), 4).where("series = 'ret'").collect()}
    want = {k: (d[:-k] * d[k:]).sum() / (d * d).sum() for k in range(1, 5)}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    r = [1, *(want[k] for k in range(1, 5))]
    for k, row in enumerate(D.pacf(series(spark, close), 4).where("series = 'ret'").orderBy("lag").collect(), 1):
        matrix = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(row.pacf - np.linalg.solve(matrix, r[1 : k + 1])[-1]) < 1e-9


def test_rolling_needs_full_windows(spark):
    assert D.rolling_vol(series(spark, [24985, 24990, 25000, 25005, 24995]), 3).count() == 2
    with pytest.raises(ValueError):
        D.rolling_vol(series(spark, [1, 2]), 1)


def test_jumps(spark):
    close = walk(100)
    close[50:] *= 1.2
    s = D.jump_summary(series(spark, close)).first()
    assert s.n_jumps >= 1 and "50" in s.jump_rows.split(",")


def exponent(x, order):
    """The exponent by least squares, segment by segment."""
    y, scales, f = np.cumsum(x - x.mean()), [], []
    for size in (s for s in M.SCALES if s <= len(x) // 4):
        count = len(x) // size
        starts = [i * size for i in range(count)] + [len(x) - (i + 1) * size for i in range(count)]
        errors = []
        for at in starts:
            part, k = y[at : at + size], np.arange(size)
            errors.append(np.mean((part - np.polyval(np.polyfit(k, part, order), k)) ** 2))
        errors = [e for e in errors if e > 0]
        if errors:
            scales.append(size)
            f.append(np.sqrt(np.mean(errors)))
    return np.polyfit(np.log(scales), np.log(f), 1)[0]


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_fluctuation_exponent(spark, order):
    close = walk(300)
    x = np.diff(np.log(close))
    got = M.dfa_hurst(D.returns(series(spark, close)), order).first().h
    assert abs(got - exponent(x, order)) < 1e-8


def test_multifractal_and_resamples(spark):
    r = D.returns(series(spark, walk(200)))
    assert sorted(x.q for x in M.scaling(r).collect()) == [-2, -1, 0, 1, 2]
    b = M.bootstrap_hurst(r, reps=12).first()
    assert b.valid == 12 and b.low <= b.high
    short = M.bootstrap_hurst(D.returns(series(spark, walk(50))), reps=12).first()
    assert (short.valid, short.low, short.high) == (0, None, None)
    mixed = M.surrogate(r).orderBy("ts").collect()
    assert sorted(x.log_ret for x in mixed) == sorted(x.log_ret for x in r.where("log_ret IS NOT NULL").collect())
    assert M.dfa_hurst(D.returns(series(spark, walk(90)))).collect() == []


def test_regimes(spark):
    labelled = regimes.labels(series(spark, walk(80, 24680)))
    assert labelled.count() == 60
    assert sum(r.n for r in regimes.stats(labelled).collect()) == 60
    assert sum(r.n for r in regimes.transitions(labelled).collect()) == 59
    assert regimes.runs(labelled).agg(F.sum(F.col("runs") * F.col("mean_length"))).first()[0] == 60


def test_joint_study_with_a_constant_index(spark):
    u, v = series(spark, walk(40)), series(spark, [15] * 40, "v")
    aligned = X.align(u, v)
    assert aligned.count() == 40
    thirds = {r.tercile: r.n for r in X.conditional_means(X.terciles(aligned)).collect()}
    assert thirds == {"LOW": 13, "MID": 13, "HIGH": 14}
    assert all(r.pearson is None and r.spearman is None for r in X.correlations(aligned).collect())


def test_sessions_batch_and_stream(spark, tmp_path):
    start = dt.datetime(2026, 9, 18, 3, 40)
    rows = [("a", start + dt.timedelta(days=d, minutes=m), d * 1000 + m, float(m % 7 + 1)) for d in range(3) for m in range(0, 400)]
    ticks = spark.createDataFrame(rows, "instrument_id string, ts timestamp, seq long, price double")
    minutes = B.bars(ticks, "instrument_id", F.date_trunc("minute", "ts"), "price", ("ts", "seq"))
    daily = B.sessionize(minutes).orderBy("session").collect()
    assert [r.minutes for r in daily] == [376] * 3 and daily[0].open == 6.0
    ticks.write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_sessions(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("session_bars_test").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.sql("SELECT * FROM session_bars_test ORDER BY day").collect()
    assert [(r.open, r.high, r.low, r.close, r.ticks) for r in found] == [(r.open, r.high, r.low, r.close, r.minutes) for r in daily]


def test_purging(spark):
    rows = [(i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 3)) for i in range(40)]
    s = spark.createDataFrame(rows, "sample int, ts timestamp, label_end timestamp")
    folds = validation.chronological_folds(s, 4)
    spans = {f: [r for r in folds.collect() if r.fold == f] for f in range(4)}
    got = {(r.sample, r.test_fold) for r in validation.purged_training(s, 4, embargo_seconds=3600).collect()}
    want = set()
    for f, test in spans.items():
        a, b = min(r.ts for r in test), max(r.label_end for r in test) + dt.timedelta(hours=1)
        want |= {(i, f) for i, t, e in rows if i not in {r.sample for r in test} and not (t <= b and e >= a)}
    assert got == want
    assert len(validation.combinatorial_folds(6, 2)) == 15
