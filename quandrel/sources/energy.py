"""Wide energy CSV files: a time column and a column a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.functions.freq import Freq
from quandrel.operators.series import dedupe_first, factorize, wide_to_long

TIME_FORMAT = "MMM d, yyyy h:mm a"


def number(text: Column) -> Column:
    """Numbers with thousands commas; '-' and anything else that is no number is null."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def energy_series(spark: SparkSession, paths: list[str], chosen: list[str] | None = None, dropped: tuple[str, ...] = ("End date",), freq: Freq = Freq("hour")) -> tuple[DataFrame, DataFrame, Freq]:
    """(long series, mapping of item_id to column, freq) of files in the order of ``paths``.

    Separator ';', thousands ',', missing '-', times like 'Jan 1, 2015 12:15 AM' under 'Start date'.  Columns are matched by
    name, whatever their order in a file; one that a file lacks is null there.  Of rows with one time the first by file and
    line stays.  Item ids count the columns in the order in which files name them; ``chosen`` picks columns by name.
    """
    header, rows = [], None
    for i, path in enumerate(paths):
        own = [h.strip() for h in spark.read.text(path).first()[0].lstrip("﻿").rstrip("\r").split(";")]
        schema = T.StructType([T.StructField(h, T.StringType()) for h in own])
        raw = spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)
        part = raw.withColumns({"_file": F.lit(i), "_line": F.monotonically_increasing_id()})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        header += [h for h in own if h not in header]
    names = [h for h in header if h != "Start date" and h not in dropped]
    if chosen is not None:
        if missing := [c for c in chosen if c not in names]:
            raise ValueError(f"no columns {missing}")
        names = [h for h in names if h in chosen]
    quoted = lambda c: F.col(f"`{c}`")
    typed = rows.select(F.to_timestamp_ntz(quoted("Start date"), F.lit(TIME_FORMAT)).alias("timestamp"), "_file", "_line", *(number(quoted(c)).alias(f"_{k}") for k, c in enumerate(names)))
    wide = dedupe_first(typed, ["timestamp"], ["_file", "_line"]).drop("_file", "_line")
    long = wide_to_long(wide, [f"_{k}" for k in range(len(names))])
    series, mapping = factorize(long, [f"_{k}" for k in range(len(names))])
    labels = F.create_map(*(x for k, c in enumerate(names) for x in (F.lit(f"_{k}"), F.lit(c))))
    return series, mapping.withColumn("name", labels[F.col("name")]), freq

