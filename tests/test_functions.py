import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq, calendar_shift
from quandrel.functions.quantiles import LEVELS, crps, crossings, pit, repaired
from quandrel.functions.transform import Transform
from quandrel.operators.regression import Stumps, nelder_mead, pinball_loss, quantile_regression

DAY0 = datetime(2024, 1, 1)


def test_shifts_equal_pandas(spark):
    rows = [(DAY0 + timedelta(days=i, hours=i % 24), n) for i in range(14) for n in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, n int")
    got = df.select("ts", "n", Freq("bday").shift(F.col("ts"), F.col("n")).alias("b"), Freq("minute", 15).shift(F.col("ts"), F.col("n")).alias("m"), Freq("day", 2).shift(F.col("ts"), F.col("n")).alias("d")).collect()
    for r in got:
        if r.n:
            assert r.b == (pd.Timestamp(r.ts) + pd.offsets.BusinessDay(r.n)).to_pydatetime()
        assert r.m == r.ts + timedelta(minutes=15 * r.n) and r.d == r.ts + timedelta(days=2 * r.n)
    leap = spark.createDataFrame([(datetime(2024, 2, 29),)], "ts timestamp_ntz").select(calendar_shift(F.col("ts"), years=-1)).first()[0]
    assert leap == datetime(2023, 2, 28)
    with pytest.raises(ValueError):
        Freq("week")


def test_buckets(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 3, 5, 46),)], "ts timestamp_ntz")
    assert df.select(Freq("day").bucket(F.col("ts")), Freq("hour").bucket(F.col("ts")), Freq("minute", 15).bucket(F.col("ts"))).first()[:] == ("2", "2_5", "2_5_3")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=9, max_size=9), st.floats(-120, 120))
def test_row_scores_equal_numpy(spark, q, y):
    q = sorted(q)
    row = spark.createDataFrame([(q, y)], "q array<double>, y double").select(crps(F.col("q"), F.col("y"), LEVELS), pit(F.col("q"), F.col("y"), LEVELS)).first()
    loss = np.mean([max(a * (y - p), (a - 1) * (y - p)) for a, p in zip(LEVELS, q)])
    assert row[0] == pytest.approx(2 * loss, abs=1e-9)
    if len(set(q)) == 9:
        want = 0.0 if y < q[0] else 1.0 if y > q[-1] else float(np.interp(y, q, LEVELS))
        assert row[1] == pytest.approx(want, abs=1e-6)


def test_repair_and_crossings(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([1.0, 2.0, 3.0],)], "q array<double>")
    assert [tuple(r) for r in df.select(repaired(F.col("q")), crossings(F.col("q"))).collect()] == [([1.0, 2.0, 3.0], 1), ([1.0, 2.0, 3.0], 0)]


@pytest.mark.parametrize("name", ["none", "log", "arcsinh", "yeo-johnson", "box-cox"])
def test_transforms_invert(spark, name):
    r = random.Random(1)
    rows = [(g, math.exp(r.gauss(0, 1)) * (1 if name in ("log", "box-cox") else r.choice([-1, 1]))) for g in (1, 2) for _ in range(200)]
    df = spark.createDataFrame(rows, "item_id int, target double")
    t = Transform(name)
    both = df.join(t.fit(df, ["item_id"]), "item_id")
    p = [F.col("lmbda"), F.col("mean"), F.col("std")]
    out = both.withColumn("z", t.forward(F.col("target"), *p)).withColumn("back", t.inverse(F.col("z"), *p))
    assert out.select(F.max(F.abs(F.col("back") - F.col("target")))).first()[0] < 1e-6
    if t.fitted:
        m = out.groupBy("item_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"), F.first("lmbda").alias("l")).collect()
        assert all(abs(x.m) < 1e-9 and abs(x.s - 1) < 1e-9 for x in m)
        if name == "box-cox":
            assert all(abs(x.l) < 0.25 for x in m)  # a log-normal sample: the power is near 0


def test_unknown_transform():
    with pytest.raises(ValueError):
        Transform("cube")


def test_quantile_regression_covers():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 3000)
    y = 1 + 2 * x + rng.normal(0, 1 + 0.3 * x)
    design = np.column_stack([np.ones_like(x), x, x])  # collinear
    for a in (0.1, 0.5, 0.9):
        beta = quantile_regression(design, y, a)
        assert abs(np.mean(y < design @ beta) - a) < 0.01
        worse = [pinball_loss(y - design @ (beta + d), a) for d in rng.normal(0, 0.05, (20, 3))]
        assert pinball_loss(y - design @ beta, a) <= min(worse) + 1e-6


def test_simplex_and_stumps():
    best = nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, np.array([0.0, 0.0]))
    assert np.allclose(best, [3, -1], atol=1e-3)
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (2000, 2))
    y = np.where(x[:, 0] > 0.5, 10, 0) + rng.normal(0, 1, 2000)
    model = Stumps(0.9, 60).fit(x, y)
    value = model.base + sum(np.where(x[:, int(j)] <= c, low, high) for j, c, low, high in model.stumps)
    assert abs(np.mean(y < value) - 0.9) < 0.03 and np.mean(value[x[:, 0] > 0.6]) > np.mean(value[x[:, 0] < 0.4]) + 5
