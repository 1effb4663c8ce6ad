"""Series made from star-schema tables: sums by item and step, on a full grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators.series import on_grid

HOUR, DAY, BDAY = Freq("hour"), Freq("day"), Freq("bday")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def summed(rows: DataFrame, item: Column, step: Column, value: Column) -> DataFrame:
    """(item_id, timestamp, target); sums are rounded to 6 decimals, so that they don't depend on the order of addition."""
    return rows.select(item.alias("item_id"), step.cast("timestamp_ntz").alias("timestamp"), value.alias("v")).groupBy("item_id", "timestamp").agg(F.round(F.sum("v"), 6).alias("target"))


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"))


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"))


def lineitem_rows(spark: SparkSession, sf_dir: str, item: str = "l_returnflag") -> DataFrame:
    return summed(table(spark, sf_dir, "lineitem"), F.col(item), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice"))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_grid(events_rows(spark, sf_dir), HOUR)


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_grid(orders_rows(spark, sf_dir), DAY)


def orders_bday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_daily(spark, sf_dir).filter(F.weekday("timestamp") < 5)


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_grid(lineitem_rows(spark, sf_dir), DAY)


def lineitem_span(spark: SparkSession, sf_dir: str) -> Row:
    """First and last day of all lines, from one column."""
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").agg(F.min(day), F.max(day)).first()
