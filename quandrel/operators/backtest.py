"""Backtests: split, forecast with everything earlier as context, calibrate, apply, for one window or rolling ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators.forecast import align
from quandrel.operators.series import KEY, drop_null_items, split_roles, tail

Window = pd.DateOffset | pd.Timedelta


def fold(test_start: datetime, train: Window | None = None, val: Window | None = None, test: Window | None = None) -> dict:
    """The bounds of one window.  The train window is measured from the test's start, so a val window shortens it."""
    start = pd.Timestamp(test_start)
    at = lambda x: None if x is None else pd.Timestamp(x).to_pydatetime()
    return {"test_start": at(start), "test_end": at(start + test) if test is not None else None, "val_start": at(start - val) if val is not None else at(start), "train_start": at(start - train) if train is not None else None}


def rolling_folds(test_start: datetime, test_end: datetime, step: Window = pd.DateOffset(years=1), train: Window | None = None, val: Window | None = None, clip: bool = False) -> list[dict]:
    """Windows that start at ``test_start`` and every ``step`` after it, while before ``test_end``.

    The last one runs its full length; with ``clip`` it ends at ``test_end``.
    """
    folds, at = [], pd.Timestamp(test_start)
    while at < pd.Timestamp(test_end):
        one = fold(at, train, val, step)
        if clip:
            one["test_end"] = min(one["test_end"], pd.Timestamp(test_end).to_pydatetime())
        folds.append(one)
        at = at + step
    return folds


def in_windows(rows: DataFrame, windows: list[tuple[datetime | None, datetime | None]], days: int = 32) -> DataFrame:
    """``rows`` with fold_id, a row for each window (start, end) that holds its timestamp; None is open.

    An equi-join on buckets of ``days`` with the windows' buckets, which are as many as folds and months: that side is
    broadcast, for it doesn't grow with the rows.
    """
    spark, ts = rows.sparkSession, F.col("timestamp")
    bucket = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / days)
    table = spark.createDataFrame([(i, *w) for i, w in enumerate(windows)], "fold_id int, _start timestamp_ntz, _end timestamp_ntz")
    lo, hi = rows.agg(F.min("timestamp"), F.max("timestamp")).first() if any(None in w for w in windows) else (None, None)
    first = F.coalesce("_start", F.lit(lo).cast("timestamp_ntz"), F.col("_end"))
    last = F.coalesce("_end", F.lit(hi).cast("timestamp_ntz"), F.col("_start"))
    dealt = table.withColumn("_bucket", F.explode(F.when(bucket(last) >= bucket(first), F.sequence(bucket(first), bucket(last))).otherwise(F.array().cast("array<bigint>"))))
    joined = rows.withColumn("_bucket", bucket(ts)).join(F.broadcast(dealt), "_bucket")
    return joined.filter((F.col("_start").isNull() | (ts >= F.col("_start"))) & (F.col("_end").isNull() | (ts < F.col("_end")))).drop("_bucket", "_start", "_end")


def by_fold(rows: DataFrame) -> DataFrame:
    """``rows`` with fold_id made part of the item's key."""
    return rows.withColumn("item_id", F.struct("fold_id", "item_id")).drop("fold_id")


@dataclass
class Backtest:
    """A predictor and named postprocessors, run over one fold or many.

    ``calibration`` names the rows that calibrate: val, train or train_val.  They are forecast without context unless
    ``calibration_context``, so that their histories start cold, as the fold's own rows do.
    """

    predictor: object
    postprocessors: dict[str, object] = field(default_factory=dict)
    freq: Freq = Freq("day")
    name: str = "raw"
    calibration: str = "val"
    calibration_context: bool = False
    context_length: int | None = None

    def __post_init__(self) -> None:
        if self.calibration not in ("val", "train", "train_val"):
            raise ValueError("calibration is val, train or train_val")

    # one step each -------------------------------------------------------------------------------------------------
    def split(self, series: DataFrame, bounds: dict) -> DataFrame:
        return split_roles(series, bounds)

    def train(self, rows: DataFrame) -> DataFrame | None:
        return self.predictor.fit(rows.filter("role = 'train'").drop("role"), rows.filter("role = 'val'").drop("role"))

    def predict(self, data: DataFrame, context: DataFrame | None = None, params: DataFrame | None = None) -> DataFrame:
        """Forecasts of the rows of ``data``, which may look back at ``context``."""
        if context is None:
            return self.predictor.predict(data, params)
        earlier = context if self.context_length is None else tail(context, self.context_length)
        whole = earlier.select(*KEY, "target").unionByName(data.select(*KEY, "target"))
        return self.predictor.predict(whole, params).join(data.select(*KEY), KEY, "left_semi")

    def train_postprocessors(self, rows: DataFrame, params: DataFrame | None = None) -> dict[str, DataFrame]:
        roles = {"val": ["val"], "train": ["train"], "train_val": ["train", "val"]}[self.calibration]
        used = rows.filter(F.col("role").isin(roles)).drop("role")
        context = rows.filter("role = 'train'").drop("role") if self.calibration_context and self.calibration == "val" else None
        aligned = align(self.predict(used, context, params), used, self.freq)
        return {name: p.fit(aligned) for name, p in self.postprocessors.items()}

    def apply(self, forecasts: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
        """The raw forecasts and each postprocessor's, in one table with a model column."""
        out = forecasts.withColumn("model", F.lit(self.name))
        for name, p in self.postprocessors.items():
            out = out.unionByName(p.apply(forecasts, fitted[name]).withColumn("model", F.lit(name)))
        return out

    # whole runs ----------------------------------------------------------------------------------------------------
    def run(self, series: DataFrame, bounds: dict, params: DataFrame | None = None, fit: bool = True) -> DataFrame:
        """(item_id, timestamp, lead_time, q, model) of the test rows; items without any test target are left out.

        Forecasts look back at all earlier data, whatever the train window.  No test target at all is an error (one job
        looks for it).  Without ``fit`` the predictor keeps ``params`` of an earlier fit.
        """
        rows = self.split(series, bounds)
        test = drop_null_items(rows.filter("role = 'test'").drop("role"))
        if test.isEmpty():
            raise ValueError("no target in the test window")
        earlier = series.filter(F.col("timestamp") < F.lit(bounds["test_start"]).cast("timestamp_ntz"))
        params = self.train(rows) if fit else params
        forecasts = self.predict(test, earlier, params)
        return self.apply(forecasts, self.train_postprocessors(rows, params)) if self.postprocessors else forecasts.withColumn("model", F.lit(self.name))

    def run_rolling(self, series: DataFrame, test_start: datetime, test_end: datetime | None = None, step: Window = pd.DateOffset(years=1), train: Window | None = None, val: Window | None = None, clip: bool = False) -> DataFrame:
        """run_folds() of windows from ``test_start`` on, to ``test_end`` or the last time of the data."""
        end = test_end if test_end is not None else series.agg(F.max("timestamp")).first()[0]
        return self.run_folds(series, rolling_folds(test_start, end, step, train, val, clip))

    def run_folds(self, series: DataFrame, folds: list[dict], params: DataFrame | None = None, fit: bool = True) -> DataFrame:
        """run() over folds, with fold_id, in one plan; items may differ by fold.  Starts jobs that look at bounds and targets.

        What a forecast knows at its origin doesn't depend on the fold, so states are computed once over the whole series,
        and an interval join names the folds of an origin.  Only fits, and forecasts that start cold in a calibration
        window, are by fold (a part of the item's key), and these see the rows of their windows alone.  ``params`` without
        ``fit`` are keyed by item_id, and hold for all folds.
        """
        start = [f["test_start"] for f in folds]
        val = [f.get("val_start") or f["test_start"] for f in folds]
        train = [f.get("train_start") for f in folds]
        windows = {"test": list(zip(start, (f.get("test_end") for f in folds))), "val": list(zip(val, start)), "train": list(zip(train, val)), "train_val": list(zip(train, start))}
        rows = series.select(*KEY, "target")
        dealt = {name: by_fold(in_windows(rows, w)) for name, w in windows.items()}
        tested = dealt["test"].filter("target is not null").select("item_id").distinct()
        found = {r[0] for r in tested.select("item_id.fold_id").distinct().collect()}  # at most one row a fold
        if missing := [i for i in range(len(folds)) if i not in found]:
            raise ValueError(f"no target in the test windows of folds {missing}")
        params = self.predictor.fit(dealt["train"], dealt["val"]) if fit else None if params is None else self._for_folds(params, len(folds))
        states = None if self.context_length is not None else self.predictor.states(rows)
        if states is not None:
            own = by_fold(in_windows(states, windows["test"])).join(tested, "item_id", "left_semi")
            forecasts = self.predictor.finish(own, params)
        else:  # a context of so many rows before each test
            earlier = by_fold(in_windows(rows, [(None, at) for at in start]))
            forecasts = self.predict(dealt["test"].join(tested, "item_id", "left_semi"), earlier, params)
        if not self.postprocessors:
            out = forecasts.withColumn("model", F.lit(self.name))
        else:
            used, context = dealt[self.calibration], self.calibration_context and self.calibration == "val"
            open_start = all(x is None for x in train) and (context or self.calibration != "val")
            if states is not None and open_start:  # histories that begin with the series
                calibration = self.predictor.finish(by_fold(in_windows(states, windows[self.calibration])), params)
            else:
                calibration = self.predict(used, dealt["train"] if context else None, params)
            aligned = align(calibration, used, self.freq)
            out = self.apply(forecasts, {name: p.fit(aligned) for name, p in self.postprocessors.items()})
        return out.withColumns({"fold_id": F.col("item_id.fold_id"), "item_id": F.col("item_id.item_id")})

    @staticmethod
    def _for_folds(params: DataFrame, n: int) -> DataFrame:
        return by_fold(params.withColumn("fold_id", F.explode(F.array(*map(F.lit, range(n))))))
