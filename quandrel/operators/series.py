"""Long series (item_id, timestamp, target): grids, splits, checks and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators.selection import last_rows

KEY = ["item_id", "timestamp"]


def check_schema(series: DataFrame) -> DataFrame:
    """``series`` itself, or an error that names what is wrong with its columns."""
    types = dict(series.dtypes)
    if missing := [c for c in (*KEY, "target") if c not in types]:
        raise ValueError(f"a series lacks {missing}")
    if types["timestamp"] not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError("timestamp isn't a time")
    if types["item_id"] not in ("int", "bigint", "smallint", "tinyint", "string"):
        raise ValueError("item_id is neither an integer nor a string")
    return series


def no_nan(c: Column) -> Column:
    """NaN and infinities as null: null is the one mark of a missing value."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def duplicates(series: DataFrame) -> DataFrame:
    """(item_id, timestamp, n) of keys that occur more than once."""
    return series.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")


def on_grid(series: DataFrame, freq: Freq) -> DataFrame:
    """All items at all steps between the first and the last time of any; target null where there was no row."""
    lo, hi = series.agg(F.min("timestamp"), F.max("timestamp")).first()
    if lo is None:
        return series.select(*KEY, "target")
    steps = F.sequence(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"), F.expr(freq.interval()))
    cells = series.select("item_id").distinct().select("item_id", F.explode(steps).alias("timestamp"))
    if freq.unit == "bday":
        cells = cells.filter(F.weekday("timestamp") < 5)
    return cells.join(series.select(*KEY, "target"), KEY, "left")


def extent(series: DataFrame) -> DataFrame:
    return series.groupBy("item_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n_rows"))


def continuity_gaps(context: DataFrame, data: DataFrame, freq: Freq) -> DataFrame:
    """(item_id, context_end, data_start) of shared items whose data doesn't begin one step after the context's end."""
    ends = context.groupBy("item_id").agg(F.max("timestamp").alias("context_end"))
    starts = data.groupBy("item_id").agg(F.min("timestamp").alias("data_start"))
    return ends.join(starts, "item_id").filter(freq.shift(F.col("context_end"), 1) != F.col("data_start"))


def dedupe_first(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def wide_to_long(wide: DataFrame, columns: list[str], ids: str = "timestamp") -> DataFrame:
    """(timestamp, item_id, target): a row for each column and row, nulls kept."""
    return wide.unpivot([ids], columns, "item_id", "target")


def factorize(series: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(series with integer ids in the order of ``names``, mapping of item_id to name)."""
    mapping = series.sparkSession.createDataFrame(list(enumerate(names)), "item_id long, name string")
    coded = series.withColumnRenamed("item_id", "name").join(F.broadcast(mapping), "name")  # names are columns of a file
    return coded.select("item_id", *(c for c in series.columns if c != "item_id")), mapping


def split_by_time(series: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(rows before the cutoff, rows from it on)."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return series.filter(F.col("timestamp") < at), series.filter(F.col("timestamp") >= at)


def role(ts: Column, test_start: Column, test_end: Column, val_start: Column, train_start: Column) -> Column:
    """train, val, test or null of a time.  Windows are measured from the test's start, the train window's too."""
    return F.when((ts >= test_start) & (test_end.isNull() | (ts < test_end)), "test").when((ts >= val_start) & (ts < test_start), "val").when((ts < val_start) & (train_start.isNull() | (ts >= train_start)), "train")


def split_roles(series: DataFrame, fold: dict) -> DataFrame:
    """``series`` with column role; rows outside all windows go.  ``fold`` has test_start, test_end, val_start, train_start."""
    edge = lambda k: F.lit(fold.get(k)).cast("timestamp_ntz")
    val_start = edge("val_start") if fold.get("val_start") is not None else edge("test_start")
    return series.withColumn("role", role(F.col("timestamp"), edge("test_start"), edge("test_end"), val_start, edge("train_start"))).filter("role is not null")


def drop_null_items(rows: DataFrame) -> DataFrame:
    """Rows of items that have a target at all."""
    return rows.join(rows.filter("target is not null").select("item_id").distinct(), "item_id", "left_semi")


def tail(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each item."""
    return last_rows(series, ["item_id"], n).select(*series.columns)


def with_context(data: DataFrame, earlier: DataFrame, n: int) -> DataFrame:
    """``data`` and the last ``n`` earlier rows of its items, with is_origin."""
    context = tail(earlier.join(data.select("item_id").distinct(), "item_id", "left_semi"), n)
    return context.withColumn("is_origin", F.lit(False)).unionByName(data.withColumn("is_origin", F.lit(True)))


def only_origins(forecasts: DataFrame, data: DataFrame) -> DataFrame:
    return forecasts.join(data.select(*KEY), KEY, "left_semi")


def common_items(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").intersect(b.select("item_id"))


def random_stretch(series: DataFrame, length: int, seed: int) -> DataFrame:
    """A contiguous stretch of each item, the same for the same seed."""
    w = W.partitionBy("item_id")
    rows = series.withColumns({"_n": F.row_number().over(w.orderBy("timestamp")), "_all": F.count("*").over(w)})
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string"))), 1, 8), 16, 10).cast("long")
    start = F.pmod(draw, F.greatest(F.col("_all") - length + 1, F.lit(1))) + 1
    return rows.filter((F.col("_n") >= start) & (F.col("_n") < start + length)).drop("_n", "_all")
