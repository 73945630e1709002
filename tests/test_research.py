"""Research controls and option surfaces: edges and known values beside the queries that SQL states."""

import math

import pytest
from pyspark.sql import functions as F

from strikeline.operators import research


def test_normal_distribution(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-90, 91)] + [(None,)], "z double").select("z", research.normal_cdf(F.col("z")).alias("p")).collect()
    for z, p in rows:
        assert p is None if z is None else abs(p - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-11


def test_every_path_holds_every_fold_once(spark):
    rows = research.combinatorial_plan(spark, 6, 2).where("is_test").collect()
    paths = {}
    for r in rows:
        paths.setdefault(r.path, []).append(r.fold)
    assert len(paths) == 5 and all(sorted(f) == list(range(6)) for f in paths.values())
    with pytest.raises(ValueError):
        research.combinatorial_plan(spark, 3, 3)


def test_overfitting_of_few_rows(spark):
    kind = "instrument_id string, ts timestamp, ret double"
    assert research.overfitting_splits(spark.createDataFrame([], kind), 4).collect() == []
    got = research.overfitting_probability(research.overfitting_splits(spark.createDataFrame([], kind), 4)).first()
    assert (got.splits, got.pbo) == (0, None)
    with pytest.raises(ValueError):
        research.overfitting_splits(spark.createDataFrame([], kind), 3)


def test_best_trial_everywhere_is_no_overfitting(spark):
    import datetime as dt

    rows = [(f"t{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), k + (i % 2) * 0.1) for k in range(1, 5) for i in range(40)]
    rows += [("t0", dt.datetime(2024, 1, 1), None)]
    splits = research.overfitting_splits(spark.createDataFrame(rows, "instrument_id string, ts timestamp, ret double"), 4)
    assert {r.trial for r in splits.collect()} == {"t4"}
    assert research.overfitting_probability(splits).first().pbo == 0


def test_prices_out_of_bounds_have_no_volatility(spark):
    rows = spark.createDataFrame([(0.0, True), (101.0, True), (-1.0, False), (None, True), (4.0, True)], "price double, call boolean")
    one = F.lit(1.0)
    got = [r.v for r in rows.select(research.implied_vol(F.col("price"), F.lit(100.0), F.lit(100.0), one, F.col("call")).alias("v")).collect()]
    assert got[:4] == [None] * 4 and abs(got[4] - 0.10034) < 1e-4


def test_many_volatilities_come_back_soon(spark):
    """5,000 options: known volatilities come back, in a time that per-row interpretation of 50 steps would pass many times over."""
    import time

    q = spark.range(5000).select("id", F.lit(100.0).alias("f"), (90.0 + F.col("id") % 20).alias("k"), (0.25 + F.col("id") % 7 / 7).alias("t"), (0.15 + F.col("id") % 13 / 20).alias("v"), (F.col("id") % 20 >= 10).alias("call"))
    at = [F.col(c) for c in ("f", "k", "t")]
    began = time.perf_counter()
    off = q.select(F.abs(research.implied_vol(research.black_price(*at, F.col("v"), F.col("call")), *at, F.col("call")) - F.col("v")).alias("off")).agg(F.max("off").alias("most"), F.count("off").alias("n")).first()
    assert off.n == 5000 and off.most < 1e-9
    assert time.perf_counter() - began < 30


def test_odd_options_have_no_volatility(spark):
    inf, nan = math.inf, math.nan
    rows = [(4.0, 100.0, inf, 1.0), (4.0, inf, 100.0, 1.0), (4.0, 100.0, 100.0, inf), (4.0, 100.0, 100.0, nan), (nan, 100.0, 100.0, 1.0), (4.0, 0.0, 100.0, 1.0), (4.0, 100.0, -1.0, 1.0), (4.0, 100.0, 100.0, 0.0), (4.0, None, 100.0, 1.0), (99.0, 100.0, 100.0, 1.0)]
    options = spark.createDataFrame(rows, "p double, f double, k double, t double")
    found = options.select(research.implied_vol(*(F.col(c) for c in "pfkt"), F.lit(True)).alias("v")).collect()
    assert [r.v for r in found] == [None] * len(rows)
    assert options.where("p IS NULL").select(research.implied_vol(*(F.col(c) for c in "pfkt"), F.lit(True))).collect() == []


def test_sabr_at_the_money_and_flat(spark):
    def at(strike, nu):
        v = research.sabr_vol(F.lit(100.0), F.lit(strike), F.lit(1.0), F.lit(0.2), 1.0, F.lit(0.0), F.lit(nu))
        return spark.range(1).select(v.alias("v")).first().v

    assert at(100.0, 0.0) == pytest.approx(0.2) and at(130.0, 1e-12) == pytest.approx(0.2)
    assert at(130.0, 0.8) > at(100.0, 0.8) < at(75.0, 0.8)
    with pytest.raises(ValueError):
        research.calibrate_sabr(spark.range(0), (), (0.2,), (1.0,), (0.5,))


def test_ledger_wants_every_field(spark, tmp_path):
    with pytest.raises(ValueError, match="status"):
        research.append_trials(spark.range(1).select(*(F.lit("x").alias(f) for f in (*research.LEDGER_FIELDS[:-1], "trial_id"))), str(tmp_path / "ledger"))


def test_protocol_without_files(spark):
    got = research.protocol_checks(spark.createDataFrame([], "path string, text string"), ["plan"], "config", "plan", "tracks").collect()
    assert len(got) == 1 + 6 + 10 + 8 and not any(r.passed for r in got)


def test_rate_without_a_curve(spark):
    o = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, None, 10), (4, "a", None)], "id long, curve string, days int")
    r = spark.createDataFrame([("a", 5, 0.1), ("a", 15, 0.2), ("a", None, 9.0)], "curve string, tenor int, rate double")
    assert {x.id: x.rate for x in research.tenor_rate(o, r, ["curve"], "id").collect()} == {1: pytest.approx(0.15), 2: None, 3: None, 4: None}
