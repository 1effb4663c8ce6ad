"""Session defaults shared by tests, the benchmark and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quandrel", cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; local, unless a submitter gave the program its gateway.

    Under spark-submit the master and every setting that the submitter gave stay; only the rest is set.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    os.environ.setdefault("TZ", "UTC")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark = SparkSession.builder.appName(app).getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in settings.items():
        if key.startswith("spark.sql.") and not given.contains(key):
            spark.conf.set(key, value)
    return spark
