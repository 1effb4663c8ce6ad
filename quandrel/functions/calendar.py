"""Calendar features of an origin and of the time that it forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq

PERIODS = {"dayofweek": 7, "week": 52, "month": 12, "hour": 24}


def parts_of(ts: Column) -> dict[str, Column]:
    return {"dayofweek": F.weekday(ts), "week": F.weekofyear(ts), "month": F.month(ts), "hour": F.hour(ts)}


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * x / period
    return F.sin(angle), F.cos(angle)


def feature_columns() -> list[str]:
    """The 23 features: the target and its cyclic date parts now and then, differences raw and cyclic, hours ahead."""
    names = ["target"]
    for when in ("now", "then"):
        names += [f"{p}_{when}_{f}" for p in PERIODS for f in ("sin", "cos")]
    return names + ["delta_hour", "delta_hour_sin", "delta_hour_cos", "delta_weekday", "delta_weekday_sin", "delta_weekday_cos"]


def calendar_features(rows: DataFrame, freq: Freq) -> DataFrame:
    """``rows`` (timestamp, lead_time, target, ...) with the features of ``lead_time`` steps ahead added."""
    now, then = parts_of(F.col("timestamp")), parts_of(freq.shift(F.col("timestamp"), F.col("lead_time")))
    new = {}
    for when, parts in (("now", now), ("then", then)):
        for p, period in PERIODS.items():
            new[f"{p}_{when}_sin"], new[f"{p}_{when}_cos"] = cyclic(parts[p], period)
    for name, part, period in (("hour", "hour", 24), ("weekday", "dayofweek", 7)):
        delta = then[part] - now[part]
        new[f"delta_{name}"] = delta
        new[f"delta_{name}_sin"], new[f"delta_{name}_cos"] = cyclic(delta, period)
    return rows.withColumns(new)
