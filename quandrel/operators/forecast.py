"""Forecast tables (item_id, timestamp, lead_time, q): alignment with actuals and views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.functions.quantiles import repaired

KEY = ["item_id", "timestamp", "lead_time"]
#: Actuals of at most so many rows (some 40 bytes each) are broadcast to the forecasts, of which each lead has as many.
BROADCAST_ROWS = 1_000_000


def forecasts_of(rows: DataFrame) -> DataFrame:
    """The one constructor of forecast rows: quantiles are sorted."""
    return rows.withColumn("q", repaired(F.col("q")))


def over_leads(origins: DataFrame, leads) -> DataFrame:
    """A row for each origin and lead; done after the quantiles, which are then computed once an origin."""
    return origins.withColumn("lead_time", F.explode(F.array(*map(F.lit, leads))))


def align(forecasts: DataFrame, series: DataFrame, freq: Freq, small: bool = False) -> DataFrame:
    """``forecasts`` with prediction_date and the target of that time, matched by time and never by row offset.

    ``small`` broadcasts the series; is_small() checks that it may.
    """
    due = forecasts.withColumn("prediction_date", freq.shift(F.col("timestamp"), F.col("lead_time")))
    actual = series.select("item_id", F.col("timestamp").alias("prediction_date"), "target")
    return due.join(F.broadcast(actual) if small else actual, ["item_id", "prediction_date"], "left")


def is_small(series: DataFrame) -> bool:
    return series.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def shifted_label(series: DataFrame, leads, freq: Freq) -> DataFrame:
    """(item_id, timestamp, lead_time, target, label): the target ``lead_time`` steps later in time."""
    rows = over_leads(series.select("item_id", "timestamp", "target"), leads)
    later = series.select("item_id", F.col("timestamp").alias("_due"), F.col("target").alias("label"))
    return rows.withColumn("_due", freq.shift(F.col("timestamp"), F.col("lead_time"))).join(later, ["item_id", "_due"], "left").drop("_due")


def wide_horizon(aligned: DataFrame, lead: int, levels) -> DataFrame:
    """One horizon with a column for each level: q10, q20, ..."""
    names = [f"q{round(x * 100, 6):g}".replace(".", "_") for x in levels]
    return aligned.filter(F.col("lead_time") == lead).select("item_id", "timestamp", *(F.col("q")[i].alias(n) for i, n in enumerate(names)), "prediction_date", "target")


def trajectory(aligned: DataFrame, series: DataFrame, freq: Freq, start=None, low: int = 0, high: int = -1, context: int = 0) -> DataFrame:
    """(item_id, at, kind, target, low, median, high): history, then forecasts, of one origin of each item.

    ``start`` is a time, a row number (negative from the end) or None for the last origin.
    """
    origins = aligned.select("item_id", "timestamp").distinct()
    up = F.row_number().over(W.partitionBy("item_id").orderBy("timestamp")) - 1
    down = -F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("timestamp")))
    if start is None or isinstance(start, int):
        at = -1 if start is None else start
        one = origins.withColumn("_n", up if at >= 0 else down).filter(F.col("_n") == at).drop("_n")
    else:
        one = origins.filter(F.col("timestamp") == F.lit(start).cast("timestamp_ntz"))
    n = F.size("q")
    end = F.element_at("q", high) if high < 0 else F.col("q")[high]
    ahead = aligned.join(one, ["item_id", "timestamp"], "left_semi").select("item_id", F.col("prediction_date").alias("at"), F.lit("forecast").alias("kind"), "target", F.col("q")[low].alias("low"), F.get("q", ((n - 1) / 2).cast("int")).alias("median"), end.alias("high"))
    history = series.join(one.withColumnRenamed("timestamp", "_origin"), "item_id").filter(F.col("timestamp") <= F.col("_origin"))
    past = history.withColumn("_n", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("timestamp")))).filter(F.col("_n") <= context)
    blank = F.lit(None).cast("double")
    return past.select("item_id", F.col("timestamp").alias("at"), F.lit("history").alias("kind"), "target", blank.alias("low"), blank.alias("median"), blank.alias("high")).unionByName(ahead)


def lead_times(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("item_id", "lead_time").distinct()


def put(forecasts: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``forecasts`` with the horizons or items (``by``) of ``new`` added or replaced."""
    return forecasts.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def explode_quantiles(forecasts: DataFrame, levels) -> DataFrame:
    """A row for each level: quantile, pred; for output only."""
    return forecasts.select(*(c for c in forecasts.columns if c != "q"), F.posexplode("q").alias("_i", "pred")).withColumn("quantile", F.array(*map(F.lit, map(float, levels)))[F.col("_i")]).drop("_i")
