import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.functions.quantiles import LEVELS
from quandrel.functions.transform import Transform
from quandrel.operators import calibrate, forecast, metrics, predictors, series
from quandrel.operators.backtest import Backtest, fold, rolling_folds

T0, HOUR, DAY = datetime(2024, 1, 1), Freq("hour"), Freq("day")


def gappy(spark, n=300, seed=0, step=timedelta(hours=1)):
    r = random.Random(seed)
    rows = [(i, T0 + k * step, None if r.random() < 0.15 else round(r.uniform(-5, 50), 2)) for i in ("a", "b") for k in range(n) if r.random() < 0.9]
    rows += [("one", T0, 3.0), *(("null", T0 + k * step, None) for k in range(5)), *(("same", T0 + k * step, 7.0) for k in range(30))]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double"), rows


def by_item(rows):
    items = defaultdict(list)
    for i, t, y in rows:
        items[i].append((t, y))
    return {i: sorted(x) for i, x in items.items()}


def near(a, b):
    return (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-9))


@pytest.mark.parametrize("chunk", [None, 40])
@pytest.mark.parametrize("last_n", [1, 7, 25])
def test_rolling_equals_a_deque(spark, last_n, chunk):
    df, rows = gappy(spark)
    got = {(r.item_id, r.timestamp): r.q for r in predictors.RollingQuantiles(leads=(1,), last_n=last_n, chunk=chunk).predict(df).collect()}
    assert len(got) == len(rows)
    for item, points in by_item(rows).items():
        state = deque(maxlen=last_n)
        for t, y in points:
            if y is not None:
                state.append(y)
            assert near(got[item, t], np.quantile(state, LEVELS) if state else None)


def test_seasonal_equals_deques(spark):
    df, rows = gappy(spark, 500)
    leads = (1, 24, 30)
    got = {(r.item_id, r.timestamp, r.lead_time): r.q for r in predictors.SeasonalQuantiles(leads=leads, last_n=3).predict(df).collect()}
    key = lambda t: (t.weekday(), t.hour)
    for item, points in by_item(rows).items():
        state = defaultdict(lambda: deque(maxlen=3))
        for t, y in points:
            if y is not None:
                state[key(t)].append(y)
            for h in leads:
                s = state[key(t + timedelta(hours=h))]
                assert near(got[item, t, h], np.quantile(s, LEVELS) if s else None)


def test_windows_equal_loops(spark):
    df, rows = gappy(spark, 60)
    past = {(r.item_id, r.timestamp): r.context for r in predictors.context_windows(df, 4).collect()}
    ahead = {(r.item_id, r.timestamp): r.future for r in predictors.future_windows(df, 3).collect()}
    for item, points in by_item(rows).items():
        y = [v for _, v in points]
        for k, (t, _) in enumerate(points):
            assert past[item, t] == ([None] * 4 + y[: k + 1])[-4:]
            assert ahead[item, t] == (y[k + 1 : k + 4] + [None] * 3)[:3]


def test_context_model_sees_the_same_windows(spark):
    df, rows = gappy(spark, 120)
    model = predictors.ContextModel(predictors.quantiles_of_context(LEVELS, (1, 2)), leads=(1, 2), length=9, chunk=16, batch=5)
    got = {(r.item_id, r.timestamp, r.lead_time): r.q for r in model.predict(df).collect()}
    assert len(got) == 2 * len(rows)
    for item, points in by_item(rows).items():
        for k, (t, _) in enumerate(points):
            some = [v for _, v in points[max(0, k - 8) : k + 1] if v is not None]
            q = got[item, t, 2]
            assert (not some and all(v is None for v in q)) or near(q, np.quantile(some, LEVELS) if some else None)
    data = df.filter(F.col("timestamp") >= T0 + timedelta(hours=80))
    early = df.filter(F.col("timestamp") < T0 + timedelta(hours=80))
    some = model.predict(series.with_context(data, early, 8)).collect()
    assert len(some) == 2 * data.count() and all(near(r.q, got[r.item_id, r.timestamp, r.lead_time]) or None in r.q for r in some)


def test_walk_odd_items(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(days=1), 0.0), ("a", T0 + timedelta(days=2), 2.0), ("b", T0, -1.0)], "item_id string, timestamp timestamp_ntz, target double")
    model = predictors.RandomWalk(leads=(1,))
    assert all(r.q is None for r in model.predict(df, model.fit(df)).collect())


def normal_rows(spark, n=500, items=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in items:
        for k in range(n):
            m = float(rng.normal(50, 10))
            y = float(m + 5 + rng.normal(0, 4))
            rows.append((i, T0 + timedelta(hours=k), 1, [m + z for z in (-4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0)], y))
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, lead_time int, q array<double>, target double")


@pytest.mark.parametrize("post", [calibrate.EmpiricalOffset(), calibrate.QuantileRegressionCalibration(), calibrate.QuantileRegressionCalibration(transform=Transform("log", 1e3)), calibrate.GaussianCalibration(), calibrate.GaussianCalibration(transform=Transform("arcsinh")), calibrate.GaussianCalibration(transform=Transform("yeo-johnson")), calibrate.BoostedCalibration(rounds=40)])
def test_calibration_covers(spark, post):
    rows = normal_rows(spark)
    params = post.fit(rows).cache()
    assert params.count() == 2
    out = post.apply(rows, params)
    used = calibrate.calibration_rows(out)
    shares = {r.quantile: r.value for r in metrics.level_table(metrics.coverage(used, LEVELS)).filter("lead_time = 1").collect()}
    assert all(abs(shares[a] - a) < 0.08 for a in LEVELS)
    assert out.filter(F.exists(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("q", i) > F.get("q", i + 1))).count() == 0
    better = [metrics.crps_rows(x, LEVELS, None).agg(F.avg("crps")).first()[0] for x in (out, rows)]
    assert better[0] < better[1]
    stranger = rows.limit(5).withColumn("item_id", F.lit("zz"))
    assert [r.q for r in post.apply(stranger, params).collect()] == [r.q for r in stranger.collect()]
    assert calibrate.without_params(stranger, params).count() == 1


def test_gaussian_recovers_and_improves(spark):
    rows = normal_rows(spark, 2000, ("a",))
    post = calibrate.GaussianCalibration()
    p = post.fit(rows).first()
    assert abs(p.y_std * p.b - p.y_std) < 0.1 * p.y_std
    sigma = (p.c + p.d * 8 / p.y_std) * p.y_std
    assert abs(sigma - 4) < 0.4


def test_rolling_folds_equal_single_backtests(spark):
    df, _ = gappy(spark, 900, 5, timedelta(days=1))
    folds = rolling_folds(datetime(2025, 1, 1), datetime(2026, 3, 1), pd.DateOffset(months=6), None, pd.DateOffset(months=6), clip=True)
    assert len(folds) == 3 and folds[-1]["test_end"] == datetime(2026, 3, 1)
    run = Backtest(predictors.RollingQuantiles(leads=(1, 3), last_n=10, freq=DAY), {"eqc": calibrate.EmpiricalOffset(warm_up=20)}, DAY)
    key = lambda r: (r.model, r.item_id, r.timestamp, r.lead_time, tuple(r.q or ()))
    whole = sorted(key(r) for r in run.run_folds(df, folds).collect())
    single = sorted(key(r) for f in folds for r in run.run(df, f).collect())
    assert whole == single and {x[0] for x in whole} == {"raw", "eqc"} and not [x for x in whole if x[1] == "null"]
    with pytest.raises(ValueError):
        Backtest(run.predictor, calibration="test")
    one = fold(datetime(2025, 1, 1), pd.DateOffset(years=1), pd.DateOffset(months=3))
    assert one["val_start"] == datetime(2024, 10, 1) and one["train_start"] == datetime(2024, 1, 1)


def test_schema_and_views(spark):
    df, rows = gappy(spark, 20)
    series.check_schema(df)
    for bad in (df.drop("target"), df.withColumn("timestamp", F.lit(1)), df.withColumn("item_id", F.lit(1.5))):
        with pytest.raises(ValueError):
            series.check_schema(bad)
    f = predictors.RollingQuantiles(leads=(1, 2), last_n=3).predict(df)
    new = f.filter("item_id = 'same'").withColumn("q", F.lit(None).cast("array<double>"))
    put = forecast.put(f, new, ["item_id"])
    assert put.count() == f.count() and put.filter("item_id = 'same' and q is not null").count() == 0
    assert forecast.lead_times(f).filter("item_id = 'a'").count() == 2
    stretch = series.random_stretch(df.filter("item_id = 'same'"), 6, 11).orderBy("timestamp").collect()
    assert len(stretch) == 6 and stretch[-1].timestamp - stretch[0].timestamp == timedelta(hours=5)
    grid = series.on_grid(df, HOUR)
    assert grid.count() == 5 * grid.select("timestamp").distinct().count() and series.on_grid(df.limit(0), HOUR).count() == 0
