"""Calibration of forecasts per item and lead: fit() makes a parameter table, apply() corrects forecasts with it.

fit() takes aligned forecasts and skips the first ``warm_up`` origins of each item and lead, counted before rows with
missing values go; apply() keeps the raw quantile where there are no parameters.  ``by`` names keys before item_id.
A column ``origin`` of the aligned forecasts, where there is one, is that count, for rows that aren't all there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.functions.quantiles import LEVELS, complete, normal_scores
from quandrel.functions.transform import Transform
from quandrel.operators.blockboost import boosted_stumps
from quandrel.operators.blockfit import GROUP_ROWS, by_size, normal_lines, packed, quantile_lines, together
from quandrel.operators.forecast import forecasts_of
from quandrel.operators.ordered import written
from quandrel.operators.regression import Stumps, nelder_mead, quantile_regression
from quandrel.operators.selection import exact_quantiles

WARM_UP = 200


class Postprocessor(Protocol):
    def fit(self, aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame: ...

    def apply(self, forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame: ...


def calibration_rows(aligned: DataFrame, warm_up: int = WARM_UP, by: Sequence[str] = ()) -> DataFrame:
    if "origin" in aligned.columns:
        rows = aligned.filter(F.col("origin") > warm_up)
    else:
        order = W.partitionBy(*by, "item_id", "lead_time").orderBy("timestamp")
        rows = aligned.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") > warm_up).drop("_n")
    return rows.filter(complete(F.col("q"), F.col("target")))


def with_params(forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left join on the keys; AQE broadcasts the parameters when they turn out small."""
    return forecasts.join(params, [*by, "item_id", "lead_time"], "left")


def without_params(forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items and leads that have no parameters."""
    keys = [*by, "item_id", "lead_time"]
    return forecasts.select(*keys).distinct().join(params.select(*keys).distinct(), keys, "left_anti")


def key_ddl(rows: DataFrame, by: Sequence[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in [*by, "item_id", "lead_time"])


def rebuilt(forecasts: DataFrame, joined: DataFrame, q: Column, use: Column) -> DataFrame:
    return forecasts_of(joined.withColumn("q", F.when(use, q).otherwise(F.col("q"))).select(*forecasts.columns))


@dataclass
class EmpiricalOffset:
    """Adds to each level the quantile of its residuals; with ``large``, by sums that hold no group's values together."""

    levels: tuple = LEVELS
    warm_up: int = WARM_UP
    large: bool = False

    def fit(self, aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = calibration_rows(aligned, self.warm_up, by)
        residuals = [F.col("target") - F.col("q")[i] for i in range(len(self.levels))]
        if self.large:
            return exact_quantiles(rows, [*by, "item_id", "lead_time"], residuals, self.levels).withColumnRenamed("q", "offsets")
        offsets = F.array(*(F.percentile(v, F.lit(float(x))) for v, x in zip(residuals, self.levels)))
        return rows.groupBy(*by, "item_id", "lead_time").agg(offsets.alias("offsets"))

    def apply(self, forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        joined = with_params(forecasts, params, by)
        return rebuilt(forecasts, joined, F.zip_with("q", "offsets", lambda p, o: p + F.coalesce(o, F.lit(0.0))), F.col("offsets").isNotNull())


@dataclass
class QuantileRegressionCalibration:
    """y ~ a + b p for each level, at that level, on transformed values.

    Groups of more than ``group_rows`` rows are fitted by sums over blocks, and not in one task.
    """

    levels: tuple = LEVELS
    warm_up: int = WARM_UP
    transform: Transform = Transform()
    group_rows: int = GROUP_ROWS

    def fit(self, aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        keys, levels, t = [*by, "item_id", "lead_time"], self.levels, self.transform
        rows = calibration_rows(aligned, self.warm_up, by)
        powers = t.fit(rows, keys)
        rows = rows.join(powers, keys)
        p = [F.col("lmbda"), F.col("mean"), F.col("std")] if t.fitted else []
        rows = rows.select(*keys, t.forward(F.col("target"), *p).alias("y"), F.transform("q", lambda x: t.forward(x, *p)).alias("x"))

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            x, y = together(frame)
            fits = [quantile_regression(x[:, [0, i + 1]], y, a).tolist() for i, a in enumerate(levels)] if len(y) > 1 else None
            return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "line": [fits]})

        small, large = by_size(packed(rows, keys, F.concat(F.array(F.lit(1.0)), "x"), F.col("y")), keys, self.group_rows)
        fitted = small.groupBy(*keys).applyInPandas(one, f"{key_ddl(rows, by)}, line array<array<double>>")
        if large is not None:
            lines = quantile_lines(large, keys, levels, [[0, i + 1] for i in range(len(levels))])
            fitted = fitted.unionByName(lines.select(*keys, F.col("beta").alias("line")))
        return fitted.join(powers, keys)

    def apply(self, forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        t = self.transform
        joined = with_params(forecasts, params, by)
        p = [F.col("lmbda"), F.col("mean"), F.col("std")] if t.fitted else []
        q = F.zip_with("q", "line", lambda x, c: t.inverse(c[0] + c[1] * t.forward(x, *p), *p))
        return rebuilt(forecasts, joined, q, F.col("line").isNotNull())


def moments(rows: DataFrame, keys: Sequence[str], y: Column) -> DataFrame:
    """(keys..., mean, std) of the non-null values, population deviation."""
    return rows.groupBy(*keys).agg(F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"))


def centred_std(y: Column, keys: Sequence[str], width: int = 20) -> Column:
    """Sample deviation of ``width`` rows about each, null where they aren't all there."""
    frame = W.partitionBy(*keys).orderBy("timestamp").rowsBetween(-(width // 2), width - width // 2 - 1)
    return F.when(F.count(y).over(frame) == width, F.stddev_samp(y).over(frame))


def start_lines(rows: DataFrame, keys: Sequence[str], y: Column, m: Column, sigma: Column, spread: Column) -> DataFrame:
    """(keys..., a, b, c, d): least squares of y on the median and of the local deviation on the spread, with floors."""
    varies = lambda x: F.stddev_pop(x) > 1e-9 * F.abs(F.avg(x))  # noqa: E731  a line through one x is rounding noise
    line = rows.groupBy(*keys).agg(
        F.when(varies(m), F.regr_intercept(y, m)).alias("a"),
        F.when(varies(m), F.regr_slope(y, m)).alias("b"),
        F.when(varies(spread), F.regr_intercept(sigma, spread)).alias("c"),
        F.when(varies(spread), F.regr_slope(sigma, spread)).alias("d"),
    )
    floor = F.lit(1e-4)
    return line.select(*keys, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(1.0)).alias("b"), F.greatest(floor, F.coalesce("c", F.lit(1e-2))).alias("c"), F.greatest(floor, F.coalesce("d", F.lit(1.0))).alias("d"))


def negative_log_likelihood(y: Column, mu: Column, sigma: Column) -> Column:
    return F.sum(F.ln(sigma) + 0.5 * F.pow((y - mu) / sigma, 2) + 0.5 * F.ln(2 * F.pi()))


@dataclass
class GaussianCalibration:
    """Normal law with mean a + b median and deviation c + d (high - low), by maximum likelihood on standardised values.

    Groups of more than ``group_rows`` rows are fitted by Newton steps on sums over blocks, and not in one task.
    """

    levels: tuple = LEVELS
    warm_up: int = WARM_UP
    transform: Transform = Transform()
    group_rows: int = GROUP_ROWS

    def rows(self, aligned: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
        """(rows with y, m, spread, sigma on the fitting scale, scale parameters, keys)."""
        keys, t = [*by, "item_id", "lead_time"], self.transform
        rows = calibration_rows(aligned, self.warm_up, by)
        powers = t.fit(rows, keys)
        p = [F.col("lmbda"), F.col("mean"), F.col("std")] if t.fitted else []
        rows = rows.join(powers, keys).select(*keys, "timestamp", t.forward(F.col("target"), *p).alias("y"), F.transform("q", lambda x: t.forward(x, *p)).alias("x"))
        scale = moments(rows, keys, F.col("y")).withColumn("y_std", F.when(F.col("y_std") > 0, F.col("y_std")).otherwise(1.0))
        unit = lambda c: (c - F.col("y_mean")) / F.col("y_std")
        rows = rows.join(scale, keys).select(*keys, "timestamp", unit(F.col("y")).alias("y"), unit(F.col("x")[len(self.levels) // 2]).alias("m"), ((F.element_at("x", -1) - F.col("x")[0]) / F.col("y_std")).alias("spread"))
        return rows.withColumn("sigma", centred_std(F.col("y"), keys)), scale.join(powers, keys), keys

    def start(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return start_lines(rows, keys, F.col("y"), F.col("m"), F.col("sigma"), F.col("spread"))

    def fit(self, aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows, scale, keys = self.rows(aligned, by)
        rows = written(rows.select(*keys, "y", "m", "spread", "sigma"), "calibration")
        start = self.start(rows, keys)
        small, large = by_size(packed(rows, keys, F.array("m", "spread"), F.col("y")), keys, self.group_rows)

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            x, y = together(frame)
            m, s = x[:, 0], x[:, 1]

            def loss(p: np.ndarray) -> float:
                sigma = p[2] + p[3] * s
                if p[2] <= 0 or p[3] <= 0 or (sigma <= 0).any():
                    return np.inf
                return float(np.sum(np.log(sigma) + 0.5 * ((y - p[0] - p[1] * m) / sigma) ** 2))

            best = nelder_mead(loss, frame[["a", "b", "c", "d"]].iloc[0].to_numpy(float))
            return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, **{c: [best[i]] for i, c in enumerate("abcd")}})

        fitted = small.join(start, keys).groupBy(*keys).applyInPandas(one, f"{key_ddl(rows, by)}, a double, b double, c double, d double")
        if large is not None:
            fitted = fitted.unionByName(normal_lines(large, keys, start).drop("nll"))
        # a group without a complete row keeps its start
        fitted = start.select(*keys, *(F.col(c).alias(f"{c}0") for c in "abcd")).join(fitted, keys, "left").select(*keys, *(F.coalesce(c, f"{c}0").alias(c) for c in "abcd"))
        return fitted.join(scale, keys)

    def apply(self, forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        t = self.transform
        joined = with_params(forecasts, params, by)
        p = [F.col("lmbda"), F.col("mean"), F.col("std")] if t.fitted else []
        unit = lambda x: (t.forward(x, *p) - F.col("y_mean")) / F.col("y_std")
        mu = F.col("a") + F.col("b") * unit(F.col("q")[len(self.levels) // 2])
        sigma = F.col("c") + F.col("d") * (unit(F.element_at("q", -1)) - unit(F.col("q")[0]))
        q = F.array(*(t.inverse((mu + sigma * z) * F.col("y_std") + F.col("y_mean"), *p) for z in normal_scores(self.levels)))
        return rebuilt(forecasts, joined, q, F.col("a").isNotNull())


@dataclass
class BoostedCalibration:
    """Boosted stumps for each level on all quantiles of the forecast.

    Groups of more than ``group_rows`` rows are fitted by sums over blocks, and not in one task.
    """

    levels: tuple = LEVELS
    warm_up: int = WARM_UP
    rounds: int = 50
    group_rows: int = GROUP_ROWS

    def fit(self, aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        keys, levels, rounds = [*by, "item_id", "lead_time"], self.levels, self.rounds
        rows = calibration_rows(aligned, self.warm_up, by).select(*keys, "target", "q")

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            x, y = together(frame)
            fits = [Stumps(a, rounds).fit(x, y) for a in levels]
            return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "base": [[f.base for f in fits]], "stumps": [[f.stumps for f in fits]]})

        small, large = by_size(packed(rows, keys, F.col("q"), F.col("target")), keys, self.group_rows)
        fitted = small.groupBy(*keys).applyInPandas(one, f"{key_ddl(rows, by)}, base array<double>, stumps array<array<array<double>>>")
        return fitted if large is None else fitted.unionByName(boosted_stumps(large, keys, levels, rounds))

    def apply(self, forecasts: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        joined = with_params(forecasts, params, by)
        step = lambda s: F.when(F.get("q", s[0].cast("int")) <= s[1], s[2]).otherwise(s[3])
        q = F.zip_with("base", "stumps", lambda b, trees: F.aggregate(trees, b, lambda total, s: total + step(s)))
        return rebuilt(forecasts, joined, q, F.col("base").isNotNull() & F.forall("q", lambda x: x.isNotNull()))
