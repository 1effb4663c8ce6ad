"""Forecasts of known values alone, against those on the whole grid; and that no shuffle carries the grid."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from quandrel.functions.freq import Freq
from quandrel.operators import calibrate, forecast
from quandrel.operators.predictors import RollingQuantiles
from quandrel.operators.series import on_grid
from quandrel.plans import catalogue

FIRST = datetime(2024, 3, 1)


def values(spark, step: timedelta, steps: int = 400):
    rng = np.random.default_rng(7)
    rows = [(item, FIRST + step * int(t), float(rng.normal())) for item, n in (("a", 150), ("b", 40), ("c", 2)) for t in rng.choice(steps, n, replace=False)]
    rows += [("d", FIRST, 1.0), ("d", FIRST + step * 3, None), ("e", FIRST + step * 9, None), ("f", None, 2.0), (None, FIRST, 3.0), ("g", FIRST + step * (steps - 1), 4.0)]
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double").repartition(5)


@pytest.mark.parametrize("unit, step", [("day", timedelta(days=1)), ("hour", timedelta(hours=1))])
@pytest.mark.parametrize("most_steps", [4096, 10])
def test_equal_to_the_grid(spark, unit, step, most_steps):
    known, model = values(spark, step), RollingQuantiles(levels=(0.1, 0.5, 0.9), leads=(1, 7), freq=Freq(unit), last_n=5)
    grid = on_grid(known, model.freq)
    want = {(r.item_id, r.timestamp, r.lead_time): r for r in forecast.align(model.predict(grid), grid, model.freq).collect() if r.target is not None}
    all_rows = model.of_known(known, most_steps=most_steps).collect()
    got = {(r.item_id, r.timestamp, r.lead_time): r for r in all_rows if r.target is not None and r.origin > 0}
    assert set(got) == set(want) and len(got) > 300
    for k, r in got.items():
        assert r.prediction_date == want[k].prediction_date and r.target == want[k].target and (r.q is None) == (want[k].q is None)
        assert r.q is None or np.allclose(r.q, want[k].q, rtol=1e-12)
        assert r.origin == (r.timestamp - FIRST) // step + 1
    assert all(r.q is None for r in all_rows if r.origin is None or r.origin <= 0)
    assert {r.item_id for r in all_rows} == set("abcdefg")


def test_warm_up_counts_the_origins_of_the_grid(spark):
    known, model = values(spark, timedelta(days=1)), RollingQuantiles(leads=(7,), freq=Freq("day"), last_n=5)
    grid = on_grid(known, model.freq)
    aligned = forecast.align(model.predict(grid), grid, model.freq)
    fit = lambda rows: {r.item_id: r.offsets for r in calibrate.EmpiricalOffset(warm_up=100).fit(rows).collect()}
    got, want = fit(model.of_known(known)), fit(aligned)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], rtol=1e-12) for i in want)


def test_leads_beyond_the_grid_and_no_rows(spark):
    known, model = values(spark, timedelta(days=1), 401), RollingQuantiles(leads=(500,), freq=Freq("day"), last_n=5)
    assert model.of_known(known).collect() == []
    assert model.of_known(known.limit(0)).collect() == []


def test_supplier_scores_lay_out_no_grid(spark):
    """The grid has some four cells a line, and each had nine quantiles in several shuffles."""
    plan = catalogue.supplier_crps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "explode([1" not in plan and "MapInArrow" not in plan
