"""Tables that set models side by side; rows have a ``model`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quandrel.operators.metrics import crps_over_time, crps_table, level_table, mean_steps


def ratio(table: DataFrame, value: str, keys: list[str], reference: str | None) -> DataFrame:
    """``value`` divided by the reference model's at the same keys; None divides by nothing.

    The reference's rows are joined, so a hot key is no hotter than in the table; a missing reference is an error.
    """
    if reference is None:
        return table
    base = table.filter(F.col("model") == reference).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_base"))
    if base.isEmpty():
        raise ValueError(f"no model {reference!r}")
    joined = table.join(base, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.select("model", *keys, (F.col(value) / F.nullif(F.col("_base"), F.lit(0.0))).alias(value))


def model_crps(rows: DataFrame, reference: str | None = None) -> DataFrame:
    """(model, lead_time, crps): lead_time null is the mean row, taken after the ratio (a mean of ratios)."""
    table = ratio(crps_table(rows, ["model"], mean_items=True), "crps", ["lead_time"], reference).select("model", "lead_time", "crps")
    return table.unionByName(mean_steps(table, "crps", [["model"]]).withColumn("lead_time", F.lit(None).cast("int")))


def model_levels(scores: DataFrame, reference: str | None = None, mean_row: bool = False) -> DataFrame:
    """(model, quantile, value) averaged over leads; the mean row is taken before the ratio (a ratio of means)."""
    table = level_table(scores, ["model"], mean_row).filter("lead_time is null").drop("lead_time")
    return ratio(table, "value", ["quantile"], reference).select("model", "quantile", "value")


def side_by_side(table: DataFrame, keys: list[str], value: str, models: list[str]) -> DataFrame:
    """A column for each of ``models``."""
    return table.groupBy(*keys).pivot("model", models).agg(F.first(value))


def ranked(table: DataFrame, value: str) -> DataFrame:
    """(model, mean, rank) of the mean rows: 1 is the least."""
    from pyspark.sql import Window as W

    return table.select("model", F.col(value).alias("mean"), F.rank().over(W.orderBy(value)).alias("rank"))  # a row a model


def rounded(table: DataFrame, decimals: int | None) -> DataFrame:
    """Doubles rounded; 0 decimals is a number too, None leaves them."""
    return table if decimals is None else table.withColumns({c: F.round(c, decimals) for c, t in table.dtypes if t == "double"})


def crps_by_period(rows: DataFrame, splits: list, first_included: bool = False, reference: str | None = None) -> DataFrame:
    """(model, period, crps): lead-mean CRPS pooled over items in (previous, split]; the first timestamp is outside.

    The bounds are a list of the caller's, so a period is a case expression and no join.
    """
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    edges = [first, *sorted(splits), last]
    ts, period = F.col("timestamp"), F.lit(None).cast("string")
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        a, b = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
        label = F.concat(F.date_format(a, "dd-MM-yyyy"), F.lit("_to_"), F.date_format(b, "dd-MM-yyyy"))
        period = F.when(((ts > a) | ((ts == a) if first_included and k == 0 else F.lit(False))) & (ts <= b), label).otherwise(period)
    means = mean_steps(rows, "crps", [["model", "item_id", "timestamp"]]).withColumn("period", period).filter("period is not null")
    return ratio(means.groupBy("model", "period").agg(F.avg("crps").alias("crps")), "crps", ["period"], reference).select("model", "period", "crps")


def model_crps_over_time(rows: DataFrame, window: int | None = None, reference: str | None = None) -> DataFrame:
    return ratio(crps_over_time(rows, ["model"], window), "crps", ["timestamp"], reference).select("model", "timestamp", "crps")


def paired(rows: DataFrame, a: str, b: str, value: str = "crps") -> DataFrame:
    """Two models' values of the same origin and lead side by side."""
    keys = ["item_id", "timestamp", "lead_time"]
    left = rows.filter(F.col("model") == a).select(*keys, F.col(value).alias("a"))
    return left.join(rows.filter(F.col("model") == b).select(*keys, F.col(value).alias("b")), keys)


def break_test(pairs: DataFrame, at, by: list[str]) -> DataFrame:
    """Change of the mean of a - b from before ``at`` to after, its HC3 standard error and t value.

    A regression on one dummy has a closed form: two groups' counts, means and sums of squares.
    """
    d, after = F.col("a") - F.col("b"), F.col("timestamp") >= F.lit(at).cast("timestamp_ntz")
    one = lambda when: (F.count(F.when(when, d)), F.avg(F.when(when, d)), F.var_pop(F.when(when, d)))
    (n0, m0, v0), (n1, m1, v1) = one(~after), one(after)
    stats = pairs.groupBy(*by).agg(n0.alias("n0"), m0.alias("m0"), v0.alias("v0"), n1.alias("n1"), m1.alias("m1"), v1.alias("v1"))
    part = lambda n, v: F.when(F.col(n) > 1, F.col(n) * F.col(v) / F.pow(F.col(n) - 1, 2))
    out = stats.select(*by, "n0", "n1", F.col("m0").alias("before"), (F.col("m1") - F.col("m0")).alias("change"), F.sqrt(part("n0", "v0") + part("n1", "v1")).alias("se"))
    return out.withColumn("t", F.col("change") / F.nullif(F.col("se"), F.lit(0.0)))
