"""Rolling backtests against single ones, and what they let a predictor see."""

from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators import calibrate, predictors
from quandrel.operators.backtest import Backtest, in_windows, rolling_folds

DAY = Freq("day")
QUARTER = pd.DateOffset(months=3)


def walks(spark, days=420):
    rng = np.random.default_rng(3)
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=d), None if rng.random() < 0.15 or (i == "late" and d < 300) else float(np.exp(rng.normal()))) for i in ("a", "b", "late") for d in range(days)]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double").repartition(3)


def keyed(df):
    return sorted((r.model, r.item_id, r.timestamp, r.lead_time, tuple(np.round(r.q, 9)) if r.q else ()) for r in df.collect())


@pytest.mark.parametrize("calibration, context, train", [("val", False, None), ("train", False, None), ("train_val", False, pd.DateOffset(months=6)), ("val", True, None), ("val", True, pd.DateOffset(months=6))])
def test_folds_equal_single_runs(spark, calibration, context, train):
    s = walks(spark)
    folds = rolling_folds(datetime(2024, 9, 1), datetime(2025, 1, 20), QUARTER, train, QUARTER)
    run = Backtest(predictors.RollingQuantiles(leads=(1, 7), last_n=9), {"eqc": calibrate.EmpiricalOffset(warm_up=5)}, DAY, calibration=calibration, calibration_context=context)
    whole = keyed(run.run_folds(s, folds))
    assert whole == sorted(x for f in folds for x in keyed(run.run(s, f))) and {x[0] for x in whole} == {"raw", "eqc"}
    assert {x[1] for x in whole} == {"a", "b", "late"}


@pytest.mark.parametrize("predictor", [predictors.RandomWalk(leads=(1, 2)), predictors.SeasonalQuantiles(leads=(1, 8), freq=DAY, last_n=4)])
def test_parameters_are_by_fold(spark, predictor):
    s = walks(spark)
    folds = rolling_folds(datetime(2024, 7, 1), datetime(2025, 1, 20), QUARTER)
    run = Backtest(predictor, freq=DAY)
    assert keyed(run.run_folds(s, folds)) == sorted(x for f in folds for x in keyed(run.run(s, f)))


def test_a_context_of_so_many_rows(spark):
    s = walks(spark)
    folds = rolling_folds(datetime(2024, 7, 1), datetime(2024, 12, 1), QUARTER)
    run = Backtest(predictors.RollingQuantiles(leads=(1,), last_n=30), freq=DAY, context_length=4)
    assert keyed(run.run_folds(s, folds)) == sorted(x for f in folds for x in keyed(run.run(s, f)))


def test_no_fit_keeps_parameters(spark):
    s = walks(spark)
    folds = rolling_folds(datetime(2024, 7, 1), datetime(2024, 12, 1), QUARTER)
    model = predictors.RandomWalk(leads=(1,))
    params = model.fit(s).withColumn("sigma", F.lit(0.5))
    run = Backtest(model, freq=DAY)
    got = keyed(run.run_folds(s, folds, params, fit=False))
    assert got == sorted(x for f in folds for x in keyed(run.run(s, f, params, fit=False))) != keyed(run.run_folds(s, folds))


@dataclass
class Counting(predictors.RollingQuantiles):
    seen: list = field(default_factory=list)

    def states(self, series):
        self.seen.append(series.count())
        return super().states(series)


def test_the_predictor_sees_each_row_once_however_many_folds(spark):
    s, seen = walks(spark), []
    for step in (QUARTER, pd.DateOffset(days=20)):
        model = Counting(leads=(1,), last_n=5)
        Backtest(model, freq=DAY).run_folds(s, rolling_folds(datetime(2024, 6, 1), datetime(2025, 1, 20), step))
        seen.append(model.seen)
    assert seen == [[s.count()]] * 2


def test_run_rolling_ends_with_the_data(spark):
    s = walks(spark)
    run = Backtest(predictors.RollingQuantiles(leads=(1,), last_n=5), freq=DAY)
    got = run.run_rolling(s, datetime(2024, 6, 1), step=pd.DateOffset(months=4))
    assert {(r.fold_id, r.lo, r.hi) for r in got.groupBy("fold_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()} == {(0, datetime(2024, 6, 1), datetime(2024, 9, 30)), (1, datetime(2024, 10, 1), datetime(2025, 1, 31)), (2, datetime(2025, 2, 1), datetime(2025, 2, 23))}


def test_windows_of_rows(spark):
    rows = spark.createDataFrame([(datetime(1969, 12, 31) + timedelta(days=40 * i),) for i in range(9)], "timestamp timestamp_ntz")
    at = [datetime(1969, 12, 31) + timedelta(days=40 * i) for i in range(9)]
    windows = [(None, at[2]), (at[1], at[4]), (at[4], None), (None, None), (at[3], at[3]), (at[5], at[2]), (datetime(1900, 1, 1), datetime(1901, 1, 1))]
    got = sorted((r.fold_id, r.timestamp) for r in in_windows(rows, windows).collect())
    assert got == sorted((i, t) for i, (a, b) in enumerate(windows) for t in at if (a is None or t >= a) and (b is None or t < b))
    assert in_windows(rows.limit(0), windows).collect() == []
