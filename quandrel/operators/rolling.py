"""Quantiles of the newest values of a series, at every row: exact order statistics without a window over a whole series.

Rows are ordered by range partitions and cut into blocks; the values of earlier blocks are summed in two levels, which
numbers every value of a series.  The number cuts a series into chunks that carry a halo of earlier values.  Rows without a
value wait in a list beside the value before them (of a block at most), so that a chunk is bounded however many of them
follow one value.  A task streams its sorted chunks through a sorted list of the last values: O(log N) comparisons a row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quandrel.operators.ordered import BLOCK_BITS, before, ordered, written

#: Values of a chunk; a chunk holds last_n at least.
CHUNK = 4_096
#: Values of a bin and numbers of a chunk, where all values count: 2^CELL_BITS.
CELL_BITS = 16


def places(n: int, levels: tuple) -> list[tuple[int, int, float, float]]:
    """For n sorted values: the two neighbours of each level, and their weights, as percentile() interpolates."""
    out = []
    for x in levels:
        at = (n - 1) * x
        lo, hi = int(at), -int(-at // 1)
        out.append((lo, hi, hi - at, at - lo) if hi > lo else (lo, lo, 1.0, 0.0))
    return out


def interpolated(low: float, high: float, w_low: float, w_high: float) -> float:
    return low if low == high else w_low * low + w_high * high


def value_events(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, block, _k, _v, _rows) of ordered rows: value number k of a key, and the rows of a block that stand at k.

    _v is null where the value itself is in an earlier block; k is 0 before the first value.
    """
    blocked = rows.withColumn("block", F.shiftright("_at", BLOCK_BITS))
    starts = before(blocked.groupBy(*by, "block").agg(F.count("target").alias("n")), by).select(*by, "block", "before")
    inside = W.partitionBy(*by, "block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    numbered = blocked.join(starts, [*by, "block"]).withColumn("_k", F.col("before") + F.count("target").over(inside))
    return numbered.groupBy(*by, "block", "_k").agg(F.max("target").alias("_v"), F.collect_list(F.struct(*columns)).alias("_rows"))


def chunks(events: DataFrame, chunk: int, last_n: int) -> DataFrame:
    """``events`` with _chunk and _mine; the last values of a chunk stand in the next one too, without their rows."""
    own = F.floor(F.col("_k") / chunk).cast("long")
    mine = F.struct(own.alias("c"), F.lit(True).alias("mine"))
    halo = F.col("_v").isNotNull() & (F.pmod("_k", F.lit(chunk)) > chunk - last_n)
    copies = F.when(halo, F.array(mine, F.struct((own + 1).alias("c"), F.lit(False).alias("mine")))).otherwise(F.array(mine))
    dealt = events.withColumn("_c", F.explode(copies))
    return dealt.withColumns({"_chunk": F.col("_c.c"), "_mine": F.col("_c.mine"), "_rows": F.when(F.col("_c.mine"), F.col("_rows"))}).drop("_c")


def rolling_quantiles(rows: DataFrame, by: list[str], levels, last_n: int | None, chunk: int | None = CHUNK, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """``rows`` with q: quantiles of the ``last_n`` newest values (all, if None) up to each row in ``order``.

    A row without a value keeps the state; before a key's first value there is none.  Rows of one key and order are in no
    stated order among themselves.  Null keys are left out.
    """
    columns, wanted = rows.columns, tuple(map(float, levels))
    if last_n is not None and last_n < 1:
        raise ValueError("last_n is positive")
    if last_n is None:
        return growing_quantiles(rows, by, wanted, order)
    dealt = chunks(value_events(ordered(rows, by, list(order)), by, columns), max(chunk or CHUNK, last_n), last_n)
    sent = dealt.repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "_k", "block").select(*by, "_chunk", "_v", "_mine", "_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, newest = None, [], deque()
        at: dict[int, list] = {}
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in (*by, "_chunk")))
            for key, value, mine in zip(keys, batch.column("_v").to_pylist(), batch.column("_mine").to_pylist()):
                if key != now:
                    now, values, newest = key, [], deque()
                if value is not None:
                    insort(values, value)
                    newest.append(value)
                    if len(newest) - 1 == last_n:
                        del values[bisect_left(values, newest.popleft())]
                n = len(values)
                if mine and n:
                    if n not in at:
                        at = at if len(at) < 1_000 else {}
                        at[n] = places(n, wanted)
                    out.append([interpolated(values[i], values[j], u, v) for i, j, u, v in at[n]])
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("_mine"), batch.column("_rows"), pa.array(out, pa.list_(pa.float64()))], ["_mine", "_rows", "q"])

    schema = T.StructType([sent.schema["_mine"], sent.schema["_rows"], T.StructField("q", T.ArrayType(T.DoubleType()))])
    found = sent.mapInArrow(run, schema).filter("_mine").select("q", F.inline("_rows"))
    return found.select(*(c for c in columns if c != "q"), "q")


def growing_quantiles(rows: DataFrame, by: list[str], levels: tuple, order: tuple[str, ...] = ("timestamp",), bits: int = CELL_BITS) -> DataFrame:
    """``rows`` with q: quantiles of all values up to each row.

    A key's values are ranked and cut into bins of at most 2^bits neighbours, and its numbers into chunks as long.  The
    values of earlier chunks are counted by bin; a chunk goes on counting, finds the bin that holds each rank it needs, and
    asks for the rank inside it; a bin and chunk answer from the bin's values so far.  So a task holds the values of a bin,
    and the asked ranks of a chunk at most; N values make N^2 / 2^(2 bits) counts.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    events = written(value_events(ordered(rows.withColumn("_key", key), ["_key"], list(order)), ["_key"], rows.columns), "events")
    ranked = ordered(events.filter("_v is not null").select("_key", "_k", "_v"), ["_key"], ["_v", "_k"], at="_rank").withColumn("block", F.shiftright("_rank", bits))
    bins = before(ranked.groupBy("_key", "block").agg(F.lit(1).alias("n")), ["_key"]).select("_key", "block", F.col("before").alias("bin"))
    placed = written(ranked.join(bins, ["_key", "block"]).select("_key", "_k", "_v", "bin", F.shiftright("_k", bits).alias("chunk")), "placed")
    counts = placed.groupBy("_key", "chunk", "bin").agg(F.count("*").alias("n")).groupBy("_key", "chunk").agg(F.collect_list(F.struct("bin", "n")).alias("cells"))
    widths = bins.groupBy("_key").agg(F.count("*").alias("width"))
    dealt = counts.join(widths, "_key").repartition("_key").sortWithinPartitions("_key", "chunk")

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("_key", "chunk", "cells", "width")}
                if row["_key"] != now:
                    now, sums = row["_key"], np.zeros(row["width"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([row["chunk"]], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], ["_key", "chunk", "sums"])
                for cell in row["cells"]:
                    sums[cell["bin"]] += cell["n"]

    sums = dealt.mapInArrow(earlier, "_key string, chunk long, sums array<long>")
    share = np.repeat(np.array(levels), 2)

    def ask(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_k")
        upto, asked = np.asarray(start["sums"].iloc[0], dtype=np.int64).cumsum(), []
        for k, b in zip(own["_k"].to_numpy(), own["bin"].to_numpy()):
            upto[b:] += 1
            at = (k - 1) * share
            rank = np.where(np.arange(len(at)) % 2, np.ceil(at), np.floor(at)).astype(np.int64)
            place = np.searchsorted(upto, rank, "right")
            asked.append(np.column_stack([place, rank - np.where(place > 0, upto[place - 1], 0)]))
        found = np.concatenate(asked)
        return pd.DataFrame({"_key": own["_key"].iloc[0], "chunk": own["chunk"].iloc[0], "bin": found[:, 0], "_k": np.repeat(own["_k"].to_numpy(), len(share)), "j": np.tile(np.arange(len(share), dtype=np.int32), len(own)), "rank": found[:, 1]})

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        asked, held = asked.sort_values("_k"), held.sort_values("_k")
        numbers, values = held["_k"].tolist(), held["_v"].tolist()
        at = bisect_left(numbers, asked["_k"].iloc[0])
        seen, out = sorted(values[:at]), []
        for k, rank in zip(asked["_k"].tolist(), asked["rank"].tolist()):
            while at < len(numbers) and numbers[at] <= k:
                insort(seen, values[at])
                at += 1
            out.append(seen[rank])
        return pd.DataFrame({"_key": asked["_key"], "_k": asked["_k"], "j": asked["j"], "value": out})

    asks = written(placed.groupBy("_key", "chunk").cogroup(sums.groupBy("_key", "chunk")).applyInPandas(ask, "_key string, chunk long, bin long, _k long, j int, rank long"), "asks")
    cells = asks.select("_key", "bin", F.col("chunk").alias("until")).distinct()
    held = placed.join(cells, ["_key", "bin"]).filter("chunk <= until").select("_key", "bin", F.col("until").alias("chunk"), "_k", "_v")
    told = asks.groupBy("_key", "bin", "chunk").cogroup(held.groupBy("_key", "bin", "chunk")).applyInPandas(answer, "_key string, _k long, j int, value double")
    lists = told.groupBy("_key", "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"]).alias("_a"))
    parts = []
    for i, x in enumerate(levels):
        at, low, high = (F.col("_k") - 1) * F.lit(x), F.col("_a")[2 * i], F.col("_a")[2 * i + 1]
        parts.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    states = lists.select("_key", "_k", F.array(*parts).alias("_q"))
    found = events.join(states, ["_key", "_k"], "left").select(F.col("_q").alias("q"), F.inline("_rows"))
    return found.select(*(c for c in rows.columns if c != "q"), "q")
