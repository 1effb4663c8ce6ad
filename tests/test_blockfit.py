"""Fits by sums over blocks against the fits of one frame."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators import blockfit, calibrate, predictors
from quandrel.operators.blockboost import boosted
from quandrel.operators.regression import pinball_loss, quantile_regression

LEVELS = (0.1, 0.5, 0.8)


def table(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for group in ("a", "b"):
        for _ in range(n):
            u, v = map(float, rng.normal(size=2))
            rows.append((group, 1, [1.0, u, v, u + v], float(2 + 3 * u - v + (0.5 + (group == "b")) * rng.gumbel())))
    rows += [("a", 1, [1.0, None, 0.0, 0.0], 1.0), ("a", 1, [1.0, 0.0, 0.0, 0.0], None), ("a", 1, [1.0, float("nan"), 0.0, 0.0], 1.0)]
    return spark.createDataFrame(rows, "item_id string, lead_time int, v array<double>, y double").repartition(5), rows[:-3]


@pytest.mark.parametrize("columns", [None])
def test_quantile_lines_lose_no_more_than_one_frame(spark, monkeypatch, columns):
    monkeypatch.setattr(blockfit, "PACK_BITS", 6)
    monkeypatch.setattr(blockfit, "BAND_ROWS", 150)
    df, rows = table(spark)
    blocks = blockfit.packed(df, ["item_id", "lead_time"], F.col("v"), F.col("y"))
    assert blocks.select(F.max(F.size("y"))).first()[0] <= 64
    got = {r.item_id: r for r in blockfit.quantile_lines(blocks, ["item_id", "lead_time"], LEVELS, columns).collect()}
    for group in ("a", "b"):
        x, y = np.array([r[2] for r in rows if r[0] == group]), np.array([r[3] for r in rows if r[0] == group])
        for i, level in enumerate(LEVELS):
            z = x if columns is None else x[:, columns[i]]
            mine = pinball_loss(y - z @ np.array(got[group].beta[i]), level)
            assert mine == pytest.approx(got[group].loss[i], rel=1e-9)
            assert mine <= pinball_loss(y - z @ quantile_regression(z, y, level), level) * (1 + 1e-6)


def aligned(spark, n=700):
    rng = np.random.default_rng(5)
    rows = []
    for item in ("a", "b"):
        for i in range(n):
            mid, width = rng.normal(10, 3), abs(rng.normal(4, 1)) + 0.5
            y = 1 + 0.9 * mid + (0.5 + 0.3 * width) * rng.normal()
            rows.append((item, datetime(2025, 1, 1) + timedelta(days=i), 1, [float(mid + width * (k - 4) / 4) for k in range(9)], None if i % 50 == 7 else float(y)))
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, lead_time int, q array<double>, target double").repartition(4)


def test_likelihood_is_no_worse_than_the_simplex(spark):
    df = aligned(spark)
    keys = ["item_id", "lead_time"]
    one, many = calibrate.GaussianCalibration(warm_up=20), calibrate.GaussianCalibration(warm_up=20, group_rows=0)
    rows, _, _ = one.rows(df)
    for fitted in ([p.fit(df).select(*keys, *"abcd") for p in (one, many)],):
        nll = [rows.join(p, keys).groupBy(*keys).agg(calibrate.negative_log_likelihood(F.col("y"), F.col("a") + F.col("b") * F.col("m"), F.col("c") + F.col("d") * F.col("spread")).alias("n")) for p in fitted]
        a, b = ({r.item_id: r.n for r in x.collect()} for x in nll)
        assert a.keys() == b.keys() == {"a", "b"} and all(b[i] <= a[i] + 1e-6 for i in a)


def test_calibration_lines_of_large_groups_lose_no_more(spark):
    df = aligned(spark)
    many, one = ({r.item_id: r.line for r in calibrate.QuantileRegressionCalibration(warm_up=20, group_rows=n).fit(df).collect()} for n in (0, 1_000_000))
    rows = calibrate.calibration_rows(df, 20).collect()
    for item in ("a", "b"):
        for i in range(9):
            loss = [pinball_loss(np.array([r.target - c[0] - c[1] * r.q[i] for r in rows if r.item_id == item]), (i + 1) / 10) for c in (many[item][i], one[item][i])]
            assert loss[0] <= loss[1] * (1 + 1e-6)


def test_boosting_of_large_groups_loses_as_little(spark):
    df = aligned(spark, 400)
    many, one = ({r.item_id: r for r in calibrate.BoostedCalibration(levels=LEVELS, warm_up=20, rounds=3, group_rows=n).fit(df).collect()} for n in (0, 1_000_000))
    rows = calibrate.calibration_rows(df, 20).collect()
    for item in ("a", "b"):
        x, y = np.array([r.q for r in rows if r.item_id == item]), np.array([r.target for r in rows if r.item_id == item])
        for i, level in enumerate(LEVELS):
            a, b, first = (pinball_loss(y - boosted(x, [f.base[i]], [t])[0], level) for f, t in ((many[item], many[item].stumps[i]), (one[item], one[item].stumps[i]), (one[item], [])))
            assert len(many[item].stumps[i]) == 3 and a == pytest.approx(b, rel=5e-3) and a < first  # leaves of few rows differ by the interpolation


def test_calendar_regression_of_large_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("a", datetime(2025, 1, 1) + timedelta(hours=i), float(50 + 10 * np.sin(i / 24 * 6.283) + rng.normal())) for i in range(400)]
    s = spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double")
    fits = [predictors.CalendarRegression(levels=(0.5,), leads=(3,), freq=Freq("hour"), epsilon=1.0, group_rows=n) for n in (0, 1_000_000)]
    a, b = ({r.timestamp: r.q[0] for r in m.predict(s, m.fit(s)).collect() if r.q} for m in fits)
    assert a.keys() == b.keys() and np.mean([abs(a[k] - b[k]) for k in a]) < 0.2


def test_no_rows(spark):
    df, _ = table(spark, 3)
    blocks = blockfit.packed(df.limit(0), ["item_id"], F.col("v"), F.col("y"))
    assert blockfit.quantile_lines(blocks, ["item_id"], LEVELS).collect() == []
