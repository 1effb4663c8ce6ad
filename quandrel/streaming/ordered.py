"""Rolling and seasonal forecasters on a stream whose rows come out of order: the same numbers as in batch.

Rows wait in keyed state until the watermark has passed them, and are then applied in the order of their time; an event-time
timer for the earliest waiting row wakes its item.  State is the last values of each bucket, and the rows that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quandrel.functions.freq import Freq
from quandrel.functions.quantiles import LEVELS
from quandrel.operators.rolling import interpolated, places

OUT = "item_id string, micros bigint, lead_time int, q array<double>"
#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InTimeOrder(StatefulProcessor):
    """Rows (micros, target, bucket, asked) of an item: a value joins its bucket, then each lead's bucket is asked."""

    def __init__(self, levels: tuple, leads: tuple, last_n: int):
        self.levels, self.leads, self.last_n = levels, leads, last_n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros bigint, target double, bucket string, asked array<string>")
        self.values = handle.getMapState("values", "bucket string", "newest array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), None if pd.isna(y) else float(y), b, list(a)) for frame in rows for m, y, b, a in zip(frame["micros"], frame["target"], frame["bucket"], frame["asked"])]
        old = min((r[0] for r in self.waiting.get()), default=None) if self.waiting.exists() else None
        self.waiting.appendList(new)
        first = min(r[0] for r in new)
        if old is None or first < old:
            self.handle.registerTimer(self.wakes(first))
        yield pd.DataFrame({"item_id": [], "micros": [], "lead_time": [], "q": []}).astype({"item_id": "object", "micros": "int64", "lead_time": "int32", "q": "object"})

    @staticmethod
    def wakes(micros: int) -> int:
        return -(-micros // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        ready, later = [r for r in rows if self.wakes(r[0]) <= due], [r for r in rows if self.wakes(r[0]) > due]
        held: dict[str, list] = {}

        def newest(bucket: str) -> list:
            if bucket not in held:
                held[bucket] = list(self.values.getValue((bucket,))[0]) if self.values.containsKey((bucket,)) else []
            return held[bucket]

        changed, out = set(), []
        for micros, target, bucket, asked in ready:
            if target is not None:
                changed.add(bucket)
                held[bucket] = [*newest(bucket), target][-self.last_n :]
            for lead, b in zip(self.leads, asked):
                values = sorted(newest(b))
                out.append((key[0], micros, lead, [interpolated(values[i], values[j], u, v) for i, j, u, v in places(len(values), self.levels)] if values else None))
        for bucket in changed:
            self.values.updateValue((bucket,), (held[bucket],))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(self.wakes(later[0][0]))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["item_id", "micros", "lead_time", "q"]).astype({"lead_time": "int32"})

    def close(self) -> None:
        pass


def forecast_stream(stream: DataFrame, freq: Freq, leads=(1,), levels=LEVELS, last_n: int = 100, delay: str = "1 hour", seasonal: bool = False) -> DataFrame:
    """(item_id, timestamp, lead_time, q) for every row of ``stream`` (item_id string, timestamp, target), in order of time.

    ``timestamp`` is a timestamp with the session's zone, as watermarks need.  A row is answered once the watermark, the
    latest time less ``delay``, has passed it; rows later than that are dropped.  ``seasonal`` asks the bucket of the time
    that is forecast, else all values of the item count.  The session's state store must be PROVIDER.
    """
    ts = F.col("timestamp")
    local = ts.cast("timestamp_ntz")
    bucket = freq.bucket(local) if seasonal else F.lit("")
    asked = F.array(*(freq.bucket(freq.shift(local, h)) if seasonal else F.lit("") for h in leads))
    rows = stream.select("item_id", "timestamp", "target").withWatermark("timestamp", delay).withColumns({"micros": F.unix_micros(ts), "bucket": bucket, "asked": asked})
    processor = InTimeOrder(tuple(map(float, levels)), tuple(leads), last_n)
    out = rows.groupBy("item_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="append", timeMode="EventTime")
    return out.select("item_id", F.timestamp_micros("micros").alias("timestamp"), "lead_time", "q")
