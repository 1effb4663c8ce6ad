"""Exchange-rate directories: one CSV a currency pair, aligned on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators.series import factorize


def symbol_of(stem: Column) -> Column:
    """The pair of a file stem: without DEX; with US last, the two codes change places."""
    pair = F.regexp_replace(stem, "^DEX", "")
    return F.when(F.endswith(pair, F.lit("US")), F.concat(F.lit("US"), F.substring(pair, F.lit(1), F.length(pair) - 2))).otherwise(pair)


def upright(value: Column, stem: Column) -> Column:
    """The rate; the inverse where US stands last; null for 0 and for no number."""
    return F.when(F.endswith(stem, F.lit("US")), F.try_divide(F.lit(1.0), value)).otherwise(value)


def aligned(rows: DataFrame) -> DataFrame:
    """All items at all times that any has: what an outer join on time gives in long form.

    The items of a folder are its files, so their list is a literal that each time is exploded over.
    """
    items = sorted(r.item_id for r in rows.select("item_id").distinct().collect())
    cells = rows.select("timestamp").distinct().select(F.explode(F.array(*map(F.lit, items)).cast("array<string>")).alias("item_id"), "timestamp")
    return cells.join(rows, ["item_id", "timestamp"], "left")


def rate_series(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Freq]:
    """(long series, mapping, freq) of every CSV in ``folder``, by name; blanks and '.' are missing."""
    raw = spark.read.schema("observation_date string, value string").option("header", True).option("enforceSchema", True).csv(f"{folder.rstrip('/')}/*.csv")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    rows = raw.select(stem.alias("stem"), F.to_date("observation_date").cast("timestamp_ntz").alias("timestamp"), F.col("value").try_cast("double").alias("value"))
    stems = sorted(r.stem for r in rows.select("stem").distinct().collect())  # a row a file
    named = rows.select(F.col("stem").alias("item_id"), "timestamp", upright(F.col("value"), F.col("stem")).alias("target"))
    series, mapping = factorize(aligned(named), stems)
    return series, mapping.withColumn("name", symbol_of(F.col("name"))), Freq("bday")
