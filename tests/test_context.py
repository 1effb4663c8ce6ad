from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators import predictors
from quandrel.operators.backtest import Backtest, fold, rolling_folds
from quandrel.sources.energy import energy_series


def daily(spark, values):
    return spark.createDataFrame([("a", datetime(2025, 1, 1) + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "item_id string, timestamp timestamp_ntz, target double")


def test_all_earlier_data_is_context_whatever_the_train_window(spark):
    s = daily(spark, range(100))
    run = Backtest(predictors.RollingQuantiles(leads=(1,), last_n=60, freq=Freq("day")), freq=Freq("day"))
    start = datetime(2025, 1, 1) + timedelta(days=80)
    one = fold(start, pd.Timedelta(days=10), None, pd.Timedelta(days=5))
    for got in (run.run(s, one), run.run_folds(s, [one])):
        assert got.filter(F.col("timestamp") == start).first().q[4] == pytest.approx(50.5)


def test_no_target_to_test_is_an_error(spark):
    s = daily(spark, [1] * 50 + [None] * 20)
    run = Backtest(predictors.RollingQuantiles(leads=(1,), last_n=5, freq=Freq("day")), freq=Freq("day"))
    start = datetime(2025, 1, 1) + timedelta(days=50)
    with pytest.raises(ValueError):
        run.run(s, fold(start))
    with pytest.raises(ValueError, match="folds .1."):
        run.run_folds(s, [fold(start - timedelta(days=10)), fold(start)])


def test_full_last_window():
    folds = rolling_folds(datetime(2025, 1, 1), datetime(2025, 9, 1), pd.DateOffset(months=6))
    assert [f["test_end"] for f in folds] == [datetime(2025, 7, 1), datetime(2026, 1, 1)]


def test_energy_columns_go_by_name(spark, tmp_path):
    one, two = tmp_path / "1.csv", tmp_path / "2.csv"
    one.write_text("Start date;End date;A;B\nJan 1, 2015 12:00 AM;x;10;20\n")
    two.write_text("Start date;B;C\nJan 1, 2015 1:00 AM;21;31\n")
    series, mapping, _ = energy_series(spark, [str(one), str(two)])
    names = {r.item_id: r.name for r in mapping.collect()}
    got = {(names[r.item_id], r.timestamp.hour): r.target for r in series.collect()}
    assert got == {("A", 0): 10, ("B", 0): 20, ("C", 0): None, ("A", 1): None, ("B", 1): 21, ("C", 1): 31}
