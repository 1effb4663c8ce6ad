import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quandrel.functions.quantiles import LEVELS
from quandrel.operators import calibrate, predictors
from quandrel.sources import energy, rates, store, tables
from quandrel.streaming.rolling import rolling_stream


def test_energy_files(spark, tmp_path):
    head = "Start date;End date;Belgium [€/MWh] Original resolutions;France\n"
    (tmp_path / "1.csv").write_text(head + "Oct 26, 2024 11:00 PM;x;1,234.5;-\nOct 27, 2024 2:00 AM;x;1;2\nOct 27, 2024 2:00 AM;x;9;9\n", encoding="utf-8")
    (tmp_path / "2.csv").write_text(head + "Oct 27, 2024 2:00 AM;x;8;8\nOct 27, 2024 12:15 PM;x;;-3.5\n", encoding="utf-8")
    s, mapping, freq = energy.energy_series(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    assert {r.item_id: r.name for r in mapping.collect()} == {0: "Belgium [€/MWh] Original resolutions", 1: "France"} and freq.unit == "hour"
    a, b, c = datetime(2024, 10, 26, 23), datetime(2024, 10, 27, 2), datetime(2024, 10, 27, 12, 15)
    assert {(r.item_id, r.timestamp): r.target for r in s.collect()} == {(0, a): 1234.5, (0, b): 1.0, (0, c): None, (1, a): None, (1, b): 2.0, (1, c): -3.5}
    one, mapping, _ = energy.energy_series(spark, [str(tmp_path / "1.csv")], ["France"])
    assert [r.name for r in mapping.collect()] == ["France"] and one.count() == 2
    with pytest.raises(ValueError):
        energy.energy_series(spark, [str(tmp_path / "1.csv")], ["Spain"])


def test_rate_files(spark, tmp_path):
    (tmp_path / "DEXCAUS.csv").write_text("observation_date,DEXCAUS\n2024-01-01,2.0\n2024-01-02,\n2024-01-03,4\n")
    (tmp_path / "DEXUSAL.csv").write_text("observation_date,DEXUSAL\n2024-01-02,0.5\n2024-01-04,.\n")
    s, mapping, freq = rates.rate_series(spark, str(tmp_path))
    assert [r.name for r in mapping.orderBy("item_id").collect()] == ["USCA", "USAL"] and freq.unit == "bday"
    got = {(r.item_id, r.timestamp.day): r.target for r in s.collect()}
    assert got == {(0, 1): 0.5, (0, 2): None, (0, 3): 0.25, (0, 4): None, (1, 1): None, (1, 2): 0.5, (1, 3): None, (1, 4): None}


def test_store_round_trip_and_reapply(spark, tmp_path):
    s = tables.lineitem_daily(spark, "/root/testdata/sf0.001")
    f = predictors.RollingQuantiles(leads=(1,), last_n=20, freq=tables.DAY).predict(s)
    from quandrel.operators.forecast import align

    post = calibrate.EmpiricalOffset()
    params = post.fit(align(f, s, tables.DAY))
    root = str(tmp_path)
    store.save(f.withColumn("model", F.lit("raw")), root, "forecasts", "r1")
    store.save(f.withColumn("model", F.lit("raw")), root, "forecasts", "r2")
    store.save(params, root, "params", "r1")
    store.save_report(spark, root, "r1", {"test_start": datetime(2000, 1, 1), "n": 20}, spark.createDataFrame([("raw", 1.5)], "model string, crps double"))
    found = store.discovered(spark, root)
    assert {r.key for r in found.select("key").distinct().collect()} == {"r1_raw", "r2_raw"} and found.count() == 2 * f.count()
    assert "PartitionFilters" in found.filter("run = 'r1'")._jdf.queryExecution().executedPlan().toString()
    again = post.apply(f, store.params_of(spark, root, "r1"))
    fresh = post.apply(f, params)
    key = lambda r: (r.item_id, r.timestamp, tuple(r.q or ()))
    assert sorted(map(key, again.collect())) == sorted(map(key, fresh.collect()))
    assert store.load_config(spark, root, "r1") == {"n": 20, "test_start": "2000-01-01 00:00:00"}
    with pytest.raises(ValueError):
        store.load_config(spark, root, "nope")


def test_stream_equals_batch(spark, tmp_path):
    batch = tables.events_hourly(spark, "/root/testdata/sf0.001").filter("item_id < 'd'").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = batch.orderBy("timestamp").limit(400).cache()
    half = rows.selectExpr("percentile(unix_timestamp(timestamp), 0.5)").first()[0]
    for late in (False, True):  # the file source takes files in the order in which they were written
        rows.filter((F.unix_timestamp("timestamp") > half) == late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = rolling_stream(stream, LEVELS, 15, "30 days").writeStream.format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    stored = spark.read.parquet(f"{tmp_path}/in").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    want = {(r.item_id, r.timestamp): r.q for r in predictors.RollingQuantiles(leads=(1,), last_n=15).predict(stored).collect()}
    got = {(r.item_id, r.timestamp): r.q for r in spark.sql("SELECT item_id, cast(timestamp AS timestamp_ntz) AS timestamp, q FROM rolled").collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert (q is None) == (got[k] is None) and (q is None or all(abs(a - b) < 1e-9 for a, b in zip(q, got[k])))
