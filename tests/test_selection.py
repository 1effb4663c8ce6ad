"""Exact quantiles by sketch and counts, and last rows by day counts, against sorted lists."""

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quandrel.operators import selection

LEVELS = (0.0, 0.1, 0.5, 0.9, 1.0)


def groups(spark):
    rng = np.random.default_rng(4)
    rows = [("big", float(v)) for v in rng.normal(size=3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 2000)] + [("skewed", float(np.exp(v))) for v in rng.normal(0, 5, 1000)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), ("two", None), (None, 1.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6), rows


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact_however_coarse_the_sketch(spark, accuracy):
    df, rows = groups(spark)
    got = {r.g: r.q for r in selection.exact_quantiles(df, ["g"], [F.col("v"), F.col("v"), -F.col("v"), F.col("v") * 2, F.col("v")], LEVELS, accuracy).collect()}
    held = defaultdict(list)
    for g, v in rows:
        held[g] += [] if v is None else [v]
    assert set(got) - {None} == set(held) - {None}
    for g in set(held) - {None}:
        if not held[g]:
            assert got[g] == [None] * 5
        else:
            v = np.array(held[g])
            assert np.allclose(got[g], [np.quantile(x, p) for x, p in zip((v, v, -v, 2 * v, v), LEVELS)], atol=1e-12)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_one_column_serves_all_levels(spark, accuracy):
    """One sketch and one row a value; with a column a level, each row was sent through nine sketches and eighteen counts."""
    df, rows = groups(spark)
    levels = (0.9, 0.0, 0.1, 0.5, 0.52, 1.0, 0.1)
    out = selection.exact_quantiles(df, ["g"], F.col("v"), levels, accuracy)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r.q for r in out.collect()}
    held = defaultdict(list)
    for g, v in rows:
        held[g] += [] if v is None else [v]
    assert set(got) == set(held) and got[None] == got["none"] == [None] * 7
    for g in set(held) - {None, "none"}:
        assert np.allclose(got[g], np.quantile(held[g], levels), atol=1e-12)


def test_no_rows(spark):
    df, _ = groups(spark)
    assert selection.exact_quantiles(df.limit(0), ["g"], [F.col("v")], (0.5,)).collect() == []
    assert selection.last_rows(df.withColumn("timestamp", F.current_timestamp()).limit(0), ["g"], 3).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 40, 10_000])
def test_last_rows(spark, n):
    rng = np.random.default_rng(9)
    rows = [(item, datetime(2025, 1, 1) + timedelta(hours=int(h)), i) for item, size in (("a", 300), ("b", 3), ("c", 60)) for i, h in enumerate(rng.choice(4000, size, replace=False))]
    df = spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, i int").repartition(5)
    got = defaultdict(set)
    for r in selection.last_rows(df, ["item_id"], n).collect():
        got[r.item_id].add((r.timestamp, r.i))
    for item in "abc":
        assert got[item] == set(sorted((t, i) for x, t, i in rows if x == item)[::-1][:n])
