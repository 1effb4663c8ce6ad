"""Forecasters: rolling and seasonal quantiles, log random walk, calendar regression, and any model of context windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.functions.calendar import calendar_features, feature_columns
from quandrel.functions.freq import Freq
from quandrel.functions.quantiles import LEVELS, level_array, normal_quantiles, of_sorted
from quandrel.operators.blockfit import GROUP_ROWS, by_size, packed, quantile_lines, together
from quandrel.operators.forecast import align, forecasts_of, over_leads, shifted_label
from quandrel.operators.rolling import CHUNK, rolling_quantiles
from quandrel.operators.selection import exact_quantiles
from quandrel.operators.regression import quantile_regression
from quandrel.operators.series import on_grid

FORECAST = "item_id {item}, timestamp timestamp_ntz, lead_time int, q array<double>"


class Predictor(Protocol):
    """fit() returns parameters as a table (or None), predict() a forecast table.

    Rolling and seasonal forecasters write the ordered series to the shared folder when predict() is called; the rest only
    declare work.
    """

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> DataFrame | None: ...

    def states(self, series: DataFrame) -> DataFrame:
        """What is known at each origin (item_id, timestamp), without parameters and from rows up to it alone."""
        ...

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        """Forecasts from states, whose item_id may be any key that ``params`` has."""
        ...

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame: ...


@dataclass
class RollingQuantiles:
    """Quantiles of the last values, the same for every lead."""

    levels: tuple = LEVELS
    leads: tuple = (1,)
    freq: Freq = Freq("hour")
    last_n: int | None = 100
    chunk: int | None = CHUNK

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> None:
        return None

    def states(self, series: DataFrame) -> DataFrame:
        origins = rolling_quantiles(series.select("item_id", "timestamp", "target"), ["item_id"], self.levels, self.last_n, self.chunk)
        return origins.select("item_id", "timestamp", "q")

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        return over_leads(forecasts_of(states), self.leads)

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return self.finish(self.states(series), params)

    def of_known(self, values: DataFrame, span: tuple[datetime, datetime] | None = None, most_steps: int = CHUNK) -> DataFrame:
        """Aligned forecasts of ``values`` (no grid: a row for each time that has one, on the steps of ``freq``), with ``origin``.

        They hold the rows with a target of align() of the forecasts on on_grid(values), and ``origin``, the number of the
        origin among all of the grid, from 1; besides them, rows without q or target, so that no item is missing.  Leads as
        long as the grid have no rows.  ``span`` is the first and last time, where the caller knows them.

        A grid of at most ``most_steps`` isn't laid out.  Then a series has a block of values at most, so a window may span
        it: values are dealt by item and lead once, and all that follows by these keys needs no other shuffle.
        """
        lo, hi = span or values.agg(F.min("timestamp"), F.max("timestamp")).first()
        plain = lo is not None and self.freq.unit != "bday" and self.last_n is not None
        steps = (hi - lo) // timedelta(seconds=self.freq.seconds()) + 1 if plain else None
        if steps is None or steps > most_steps:
            grid = on_grid(values, self.freq)
            order = W.partitionBy("item_id", "lead_time").orderBy("timestamp")
            number = F.row_number().over(order).cast("long") if steps is None else self.freq.steps_from(F.lit(lo).cast("timestamp_ntz"), F.col("timestamp")) + 1
            return align(self.predict(grid), grid, self.freq).withColumn("origin", number)
        leads = [h for h in self.leads if h < steps]
        known = F.col("target").isNotNull() & F.col("timestamp").isNotNull()
        at = F.when(known, self.freq.steps_from(F.lit(lo).cast("timestamp_ntz"), F.col("timestamp")))
        rows = values.filter("item_id is not null").select("item_id", "timestamp", "target", at.alias("_at"))
        # an empty list of leads has a type too, and no rows
        rows = rows.withColumn("lead_time", F.explode(F.array(*map(F.lit, leads)).cast("array<int>"))).repartition("item_id", "lead_time")
        inside = W.partitionBy("item_id", "lead_time").orderBy(F.asc_nulls_last("_at"))  # unknown values stand behind all others
        last = F.sort_array(F.collect_list("target").over(inside.rowsBetween(1 - self.last_n, 0)))
        rows = forecasts_of(rows.withColumn("_last", last).withColumn("q", F.when(known, of_sorted(F.col("_last"), self.levels))))
        states = [F.when(F.col("lead_time") == h, F.last("q").over(inside.rangeBetween(W.unboundedPreceding, -h))) for h in leads]
        q = F.when(known, F.coalesce(*states)) if states else F.col("q")
        origin = self.freq.shift(F.col("timestamp"), -F.col("lead_time"))
        return rows.select("item_id", F.col("timestamp").alias("prediction_date"), origin.alias("timestamp"), "lead_time", q.alias("q"), F.when(known, F.col("target")).alias("target"), (F.col("_at") - F.col("lead_time") + 1).alias("origin"))


@dataclass
class SeasonalQuantiles:
    """Quantiles of the last values in the season of the time that is forecast, as known at the origin."""

    levels: tuple = LEVELS
    leads: tuple = (1,)
    freq: Freq = Freq("hour")
    last_n: int | None = 10
    chunk: int | None = CHUNK

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> None:
        return None

    def states(self, series: DataFrame) -> DataFrame:
        """As-of by numbers: what is asked of a bucket stands among its values as a row without one, and keeps their state."""
        rows = series.select("item_id", "timestamp", "target")
        known = rows.filter("target is not null").select("item_id", self.freq.bucket(F.col("timestamp")).alias("bucket"), "timestamp", F.lit(-1).alias("lead_time"), "target")
        asked = over_leads(rows.select("item_id", "timestamp"), self.leads)
        asked = asked.withColumns({"bucket": self.freq.bucket(self.freq.shift(F.col("timestamp"), F.col("lead_time"))), "target": F.lit(None).cast("double")})
        # lead_time -1 sorts first: a value counts for what is asked at its own time
        states = rolling_quantiles(known.unionByName(asked), ["item_id", "bucket"], self.levels, self.last_n, self.chunk, ("timestamp", "lead_time"))
        return states.filter("lead_time >= 0").select("item_id", "timestamp", "lead_time", "q")

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        return forecasts_of(states)

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return self.finish(self.states(series), params)


@dataclass
class RandomWalk:
    """Driftless log random walk: y exp(z sigma sqrt(h)); sigma from the train rows' log differences."""

    levels: tuple = LEVELS
    leads: tuple = (1,)
    freq: Freq = Freq("day")

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> DataFrame:
        log = F.when(F.col("target") > 0, F.ln("target"))
        step = log - F.lag(log).over(W.partitionBy("item_id").orderBy("timestamp"))
        return train.select("item_id", step.alias("step")).groupBy("item_id").agg(F.stddev_pop("step").alias("sigma"))

    def states(self, series: DataFrame) -> DataFrame:
        return series.select("item_id", "timestamp", "target")

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        rows = over_leads(states.join(params, "item_id", "left"), self.leads)
        log = F.when(F.col("target") > 0, F.ln("target"))
        q = F.transform(normal_quantiles(log, F.col("sigma") * F.sqrt("lead_time"), self.levels), F.exp)
        return forecasts_of(rows.select("item_id", "timestamp", "lead_time", F.when(F.col("target").isNotNull() & F.col("sigma").isNotNull(), q).alias("q")))

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return self.finish(self.states(series), params if params is not None else self.fit(series))


@dataclass
class CalendarRegression:
    """Linear quantile regression of log targets on calendar features, for each item, lead and level.

    Groups of more than ``group_rows`` rows are fitted by sums over blocks, and not in one task.
    """

    levels: tuple = LEVELS
    leads: tuple = (1,)
    freq: Freq = Freq("hour")
    epsilon: float = 1e5
    features: list[str] = field(default_factory=feature_columns)
    group_rows: int = GROUP_ROWS

    def _features(self, rows: DataFrame) -> DataFrame:
        return calendar_features(rows, self.freq)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> DataFrame:
        """(item_id, lead_time, coefficients): an array for each level, the constant first."""
        rows = self._features(shifted_label(train, self.leads, self.freq)).filter("label is not null and target is not null")
        rows = rows.select("item_id", "lead_time", F.ln(F.col("label") + self.epsilon).alias("label"), *(F.ln(F.col(c) + self.epsilon).alias(c) if c == "target" else F.col(c).cast("double") for c in self.features))
        names, levels = self.features, self.levels

        keys = ["item_id", "lead_time"]

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            x, y = together(frame)
            return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "coefficients": [[quantile_regression(x, y, a).tolist() for a in levels]]})

        small, large = by_size(packed(rows, keys, F.array(F.lit(1.0), *names), F.col("label")), keys, self.group_rows)
        fitted = small.groupBy(*keys).applyInPandas(one, f"item_id {dict(rows.dtypes)['item_id']}, lead_time int, coefficients array<array<double>>")
        if large is not None:
            fitted = fitted.unionByName(quantile_lines(large, keys, levels).select(*keys, F.col("beta").alias("coefficients")))
        return fitted

    def states(self, series: DataFrame) -> DataFrame:
        return series.select("item_id", "timestamp", "target")

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        rows = self._features(over_leads(states, self.leads)).join(params, ["item_id", "lead_time"], "left")
        x = [F.lit(1.0), *(F.ln(F.col(c) + self.epsilon) if c == "target" else F.col(c).cast("double") for c in self.features)]
        value = lambda c: sum((c[i] * v for i, v in enumerate(x)), F.lit(0.0))
        q = F.array(*(F.exp(value(F.col("coefficients")[i])) - self.epsilon for i in range(len(self.levels))))
        return forecasts_of(rows.select("item_id", "timestamp", "lead_time", F.when(F.col("target").isNotNull() & F.col("coefficients").isNotNull(), q).alias("q")))

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return self.finish(self.states(series), params)


def context_windows(series: DataFrame, length: int) -> DataFrame:
    """``series`` with context: the last ``length`` targets up to each row, nulls kept, padded with null on the left."""
    frame = W.partitionBy("item_id").orderBy("timestamp").rowsBetween(1 - length, 0)
    values = F.transform(F.collect_list(F.struct("target")).over(frame), lambda x: x["target"])
    rows = series.withColumn("context", values)
    return rows.withColumn("context", F.concat(F.array_repeat(F.lit(None).cast("double"), length - F.size("context")), "context"))


def future_windows(series: DataFrame, length: int) -> DataFrame:
    """``series`` with future: the next ``length`` targets after each row, padded with null on the right."""
    frame = W.partitionBy("item_id").orderBy("timestamp").rowsBetween(1, length)
    values = F.transform(F.collect_list(F.struct("target")).over(frame), lambda x: x["target"])
    rows = series.withColumn("future", values)
    return rows.withColumn("future", F.concat("future", F.array_repeat(F.lit(None).cast("double"), length - F.size("future"))))


def sample_quantiles(samples: DataFrame, levels, large: bool = False) -> DataFrame:
    """(item_id, timestamp, lead_time, q) from sampled trajectories (..., value); with ``large``, by exact_quantiles()."""
    keys = ["item_id", "timestamp", "lead_time"]
    if large:
        return forecasts_of(exact_quantiles(samples, keys, F.col("value"), levels))
    return forecasts_of(samples.groupBy(*keys).agg(F.percentile("value", level_array(levels)).alias("q")))


@dataclass
class ContextModel:
    """Any function from contexts [n, length] (missing values NaN) to quantiles [n, levels, leads], loaded once a worker.

    Windows are made in the task that uses them, a chunk of a series with the rows before it, and aren't stored.
    """

    model: Callable[[np.ndarray], np.ndarray]
    levels: tuple = LEVELS
    leads: tuple = (1,)
    freq: Freq = Freq("hour")
    length: int = 64
    batch: int = 16
    chunk: int = 4096

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> None:
        return None

    def finish(self, states: DataFrame, params: DataFrame | None) -> DataFrame:
        return forecasts_of(states)

    def predict(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return self.finish(self.states(series), params)

    def states(self, series: DataFrame) -> DataFrame:
        """Forecasts of rows with is_origin true, or of all rows where there is no such column."""
        length, chunk, batch, model, leads = self.length, self.chunk, self.batch, self.model, list(self.leads)
        origin = F.col("is_origin") if "is_origin" in series.columns else F.lit(True)
        n = F.row_number().over(W.partitionBy("item_id").orderBy("timestamp")) - 1
        rows = series.select("item_id", "timestamp", "target", origin.alias("is_origin"), n.alias("n"))
        own = (F.col("n") / chunk).cast("long")
        reach = F.ceil((length - 1) / F.lit(chunk)).cast("long")
        last = ((F.col("n") + length - 1) / chunk).cast("long")
        dealt = rows.withColumn("part", F.explode(F.sequence(own, F.least(last, own + reach)))).withColumn("own", own)

        def windows(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("n")
            values = np.concatenate([np.full(length - 1, np.nan), frame["target"].to_numpy(float)])
            views = np.lib.stride_tricks.sliding_window_view(values, length)
            at = np.flatnonzero((frame["own"] == frame["part"]).to_numpy() & frame["is_origin"].to_numpy(bool))
            out = []
            for i in range(0, len(at), batch):
                out.append(np.sort(np.asarray(model(views[at[i : i + batch]].copy()), float), axis=1))
            if not out:
                return frame.iloc[:0][["item_id", "timestamp"]].assign(lead_time=np.int32(0), q=None)
            got = np.concatenate(out)
            chosen = frame.iloc[at]
            return pd.concat([pd.DataFrame({"item_id": chosen["item_id"], "timestamp": chosen["timestamp"], "lead_time": h, "q": list(got[:, :, k])}) for k, h in enumerate(leads)])

        out = dealt.groupBy("item_id", "part").applyInPandas(windows, FORECAST.format(item=dict(series.dtypes)["item_id"]))
        return out.withColumn("q", F.transform("q", lambda x: F.when(~F.isnan(x), x)))


def quantiles_of_context(levels=LEVELS, leads=(1,)) -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in model: quantiles of the context's values."""

    def model(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            q = np.full((len(x), len(levels)), np.nan)
            some = ~np.isnan(x).all(axis=1)
            if some.any():
                q[some] = np.nanquantile(x[some], levels, axis=1).T
        return np.repeat(q[:, :, None], len(leads), axis=2)

    return model


