"""Streams whose rows arrive out of order against the forecasters in batch."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quandrel.functions.freq import Freq
from quandrel.operators import predictors
from quandrel.streaming import ordered

HOUR = Freq("hour")


@pytest.mark.parametrize("seasonal", [False, True])
def test_shuffled_arrival_equals_batch(spark, tmp_path, seasonal):
    rng = np.random.default_rng(8)
    rows = [(item, datetime(2025, 1, 1) + timedelta(hours=h), None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))) for item in ("a", "b") for h in range(400)]
    # arrival: by time plus up to five days, cut in batches; then a row that moves the watermark past all
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(hours=float(rng.uniform(0, 120))))
    batches = [arrival[:300], arrival[300:550], arrival[550:], [(item, datetime(2025, 6, 1), None) for item in ("a", "b")]]
    schema = "item_id string, timestamp timestamp, target double"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the file source takes files in the order in which they were written
    leads, last_n = (1, 24), 5
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    name = f"ordered_{seasonal}".lower()
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        out = ordered.forecast_stream(stream, HOUR, leads, last_n=last_n, delay="6 days", seasonal=seasonal)
        query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = {(r.item_id, r.timestamp, r.lead_time): r.q for r in spark.table(name).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).collect()}
    series = spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double")
    model = (predictors.SeasonalQuantiles if seasonal else predictors.RollingQuantiles)(leads=leads, last_n=last_n, freq=HOUR)
    want = {(r.item_id, r.timestamp, r.lead_time): r.q for r in model.predict(series).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert (q is None) == (got[k] is None) and (q is None or np.allclose(q, got[k], atol=1e-9))
