"""Scores of aligned forecasts (item_id, timestamp, lead_time, q, target).

Means are means of means, over time, then leads, then items, as each step is asked for; they are never pooled.  With more
keys (a model column, a fold), pass them in ``by``: the same steps then run for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.functions.quantiles import complete, crps, crossings, pinball, pit


def chosen(aligned: DataFrame, items: Sequence | None = None, leads: Sequence | None = None) -> DataFrame:
    """Rows of some items and leads; None is all."""
    if items is not None:
        aligned = aligned.filter(F.col("item_id").isin(list(items)))
    return aligned if leads is None else aligned.filter(F.col("lead_time").isin(list(leads)))


def trimmed(aligned: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Without the last ``most`` origins of each item and lead: their targets aren't all known."""
    last = W.partitionBy(*by, "item_id", "lead_time").orderBy(F.desc("timestamp"))
    return aligned.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") > most).drop("_n")


def crps_rows(aligned: DataFrame, levels, most_lead: int | None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., item_id, timestamp, lead_time, crps); ``most_lead`` trims the tail, None keeps it."""
    rows = aligned if most_lead is None else trimmed(aligned, most_lead, by)
    return rows.select(*by, "item_id", "timestamp", "lead_time", crps(F.col("q"), F.col("target"), levels).alias("crps"))


def mean_steps(rows: DataFrame, value: str, steps: Sequence[Sequence[str]]) -> DataFrame:
    """The mean of ``value`` by each list of keys in turn, each over the means before."""
    for keys in steps:
        rows = rows.groupBy(*keys).agg(F.avg(value).alias(value))
    return rows


def crps_table(rows: DataFrame, by: Sequence[str] = (), mean_leads: bool = False, mean_items: bool = False) -> DataFrame:
    """Mean CRPS by item and lead, or over leads, items, or both."""
    steps = [[*by, "item_id", "lead_time"]]
    if mean_leads:
        steps.append([*by, "item_id"])
    if mean_items:
        steps.append([*by] if mean_leads else [*by, "lead_time"])
    return mean_steps(rows, "crps", steps)


def crps_over_time(rows: DataFrame, by: Sequence[str] = (), window: int | None = None) -> DataFrame:
    """(by..., timestamp, crps): mean over leads, then items; ``window`` adds a trailing mean, null until it is full."""
    mean = mean_steps(rows, "crps", [[*by, "item_id", "timestamp"], [*by, "timestamp"]])
    return mean if window is None else mean.withColumn("crps", trailing_mean("crps", by, window))


def trailing_mean(value: str, by: Sequence[str], window: int):
    frame = W.partitionBy(*(by or [F.lit(0)])).orderBy("timestamp").rowsBetween(1 - window, 0)
    return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))


def by_level(aligned: DataFrame, levels, what, by: Sequence[str] = ()) -> DataFrame:
    """(by..., item_id, lead_time, quantile, value): the mean over time of ``what(pred, y, level)``, one pass for all levels."""
    means = aligned.groupBy(*by, "item_id", "lead_time").agg(*(F.avg(what(F.col("q")[i], F.col("target"), x)).alias(f"_{i}") for i, x in enumerate(levels)))
    rows = F.array(*(F.struct(F.lit(float(x)).alias("quantile"), F.col(f"_{i}").alias("value")) for i, x in enumerate(levels)))
    return means.select(*by, "item_id", "lead_time", F.inline(rows))


def pinball_scores(aligned: DataFrame, levels, by: Sequence[str] = ()) -> DataFrame:
    return by_level(aligned, levels, pinball, by)


def coverage(aligned: DataFrame, levels, by: Sequence[str] = ()) -> DataFrame:
    """Share of complete rows whose prediction is at or over the target."""
    rows = aligned.filter(complete(F.col("q"), F.col("target")))
    return by_level(rows, levels, lambda p, y, _: (p >= y).cast("double"), by)


def level_table(scores: DataFrame, by: Sequence[str] = (), mean_row: bool = False) -> DataFrame:
    """(by..., quantile, lead_time, value): means over items; lead_time null is the mean over leads, quantile null over levels."""
    cells = mean_steps(scores, "value", [[*by, "quantile", "lead_time"]])
    column = mean_steps(cells, "value", [[*by, "quantile"]]).withColumn("lead_time", F.lit(None).cast("int"))
    table = cells.unionByName(column)
    if mean_row:
        row = mean_steps(table, "value", [[*by, "lead_time"]]).withColumn("quantile", F.lit(None).cast("double"))
        table = table.unionByName(row)
    return table


def pit_values(aligned: DataFrame, levels) -> DataFrame:
    rows = aligned.filter(complete(F.col("q"), F.col("target")))
    return rows.select("item_id", "timestamp", "lead_time", pit(F.col("q"), F.col("target"), levels).alias("pit"))


def pit_histogram(values: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, uniform): counts in equal bins of [0, 1], empty ones too, and the count of a flat histogram."""
    bin_ = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(*by).agg(F.count("*").alias("all"), *(F.count_if(bin_ == i).alias(f"_{i}") for i in range(bins)))
    rows = F.array(*(F.struct(F.lit(i).alias("bin"), F.col(f"_{i}").alias("n")) for i in range(bins)))
    return counts.select(*by, "all", F.inline(rows)).select(*by, "bin", "n", (F.col("all") / bins).alias("uniform"))


def crossing_count(forecasts: DataFrame) -> DataFrame:
    """Rows whose quantiles are out of order, before they are repaired."""
    return forecasts.groupBy("item_id", "lead_time").agg(F.count_if(crossings(F.col("q")) > 0).alias("n_crossed"))
