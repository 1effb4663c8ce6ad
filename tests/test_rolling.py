"""Rolling and growing quantiles in blocks, chunks and bins of any size, against lists."""

from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest

from quandrel.operators import ordered, rolling

LEVELS = (0.0, 0.1, 0.5, 0.77, 1.0)


def gappy(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for item, missing in (("a", 0.2), ("nulls", 1.0), ("runs", 0.9), ("ties", 0.0), (None, 0.3), ("one", 0.0)):
        for i in range(1 if item == "one" else n):
            value = float(rng.integers(0, 3)) if item == "ties" else float(np.round(rng.normal(), 3))
            rows.append((item, 7, datetime(2025, 1, 1) + timedelta(hours=i), None if rng.random() < missing else value, f"x{i}"))
    return spark.createDataFrame(rows, "item_id string, k int, timestamp timestamp_ntz, target double, note string").repartition(4), rows


def want(rows, last_n):
    state, out = defaultdict(lambda: deque(maxlen=last_n)), {}
    for item, _, t, y, note in sorted(rows, key=lambda r: r[2]):
        if y is not None:
            state[item].append(y)
        out[item, t] = (note, np.quantile(state[item], LEVELS) if state[item] else None)
    return out


def check(got, rows, last_n):
    expected = want([r for r in rows if r[0] is not None], last_n)
    got = [r for r in got if r.item_id is not None]
    assert len(got) == len(expected)
    for r in got:
        note, q = expected[r.item_id, r.timestamp]
        assert r.note == note and (r.q is None) == (q is None) and (q is None or np.allclose(r.q, q, atol=1e-9))


@pytest.mark.parametrize("block, run, chunk, last_n", [(2, 1, 3, 3), (3, 2, 1, 20), (12, 12, None, 11), (1, 1, 50, 1)])
def test_rolling(spark, monkeypatch, block, run, chunk, last_n):
    monkeypatch.setattr(ordered, "RUN_BITS", run)
    monkeypatch.setattr(rolling, "BLOCK_BITS", block)
    df, rows = gappy(spark)
    got = rolling.rolling_quantiles(df, ["item_id", "k"], LEVELS, last_n, chunk)
    assert got.columns == [*df.columns, "q"]
    check(got.collect(), rows, last_n)


@pytest.mark.parametrize("bits, block", [(3, 2), (6, 12), (16, 12)])
def test_growing(spark, monkeypatch, bits, block):
    monkeypatch.setattr(rolling, "BLOCK_BITS", block)
    df, rows = gappy(spark, 150)
    check(rolling.growing_quantiles(df, ["item_id", "k"], LEVELS, bits=bits).collect(), rows, None)


def test_no_window_spans_a_series(spark):
    df, _ = gappy(spark, 30)
    plan = rolling.rolling_quantiles(df, ["item_id", "k"], LEVELS, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("block" in line or "_run" in line for line in windows)


def test_no_rows_and_bad_sizes(spark):
    df, _ = gappy(spark, 3)
    for last_n in (4, None):
        assert rolling.rolling_quantiles(df.limit(0), ["item_id", "k"], LEVELS, last_n).collect() == []
    with pytest.raises(ValueError):
        rolling.rolling_quantiles(df, ["item_id"], LEVELS, 0)
