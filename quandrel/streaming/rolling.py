"""The rolling quantile forecaster on a stream: the same numbers as in batch, a state of the last values an item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quandrel.functions.quantiles import LEVELS, repaired


def rolling_stream(stream: DataFrame, levels=LEVELS, last_n: int = 100, delay: str = "1 hour") -> DataFrame:
    """(item_id, timestamp, q) for every row of ``stream`` (item_id string, timestamp, target) in time order a micro-batch.

    ``timestamp`` is a timestamp with the session's zone, as watermarks need; rows later than ``delay`` are dropped.
    """
    wanted = list(levels)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values("timestamp", kind="stable")
        out = []
        for t, y in zip(rows["timestamp"], rows["target"], strict=True):
            if not pd.isna(y):
                values = [*values, float(y)][-last_n:]
            out.append(np.quantile(values, wanted).tolist() if values else None)
        state.update((values,))
        yield pd.DataFrame({"item_id": key[0], "timestamp": rows["timestamp"].to_numpy(), "q": out})

    late = stream.select("item_id", "timestamp", "target").withWatermark("timestamp", delay)
    out = late.groupBy("item_id").applyInPandasWithState(step, "item_id string, timestamp timestamp, q array<double>", "last array<double>", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("q", repaired(F.col("q")))
