"""Order statistics of groups of any size by mergeable sums: a sketch bounds each rank, exact counts choose inside the bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.operators.ordered import written

#: The sketch's ranks are off by at most 1 / ACCURACY of a group.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], values: Column | Sequence[Column], levels: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys..., q): for each level the quantile of its own of ``values``, interpolated as percentile() does; nulls don't count.

    One column as ``values`` serves all levels, with one sketch and one row a value.  First pass: a mergeable sketch a group
    and column gives for each level two values between which the rank must lie.  Second pass: values between are counted by
    value, all others by the gap between bounds in which they lie, with the gap's least and largest value; all of it adds up
    before the shuffle.  What is sorted is a few thousandths of a group's distinct values for each level.  A level without
    any value is null, and so are all levels of a null key.
    """
    keys, levels, shared = list(keys), [float(x) for x in levels], isinstance(values, Column)
    columns, asked = ([values], [levels]) if shared else (list(values), [[x] for x in levels])
    table = written(rows.select(*keys, *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(columns))), "values")
    slack = 1.5 / accuracy
    bounds = []
    for i, wanted in enumerate(asked):
        ends = F.array(*(F.lit(max(0.0, x - slack)) for x in wanted), *(F.lit(min(1.0, x + slack)) for x in wanted))
        bounds.append(F.struct(F.percentile_approx(f"_v{i}", ends, F.lit(accuracy)).alias("ends"), F.count(f"_v{i}").alias("n")))
    sketch = written(table.groupBy(*keys).agg(F.array(*bounds).alias("_b")), "bounds")  # a table, so that AQE can split a large group
    each = table.select(*keys, F.lit(0).alias("_i"), F.col("_v0").alias("_v")) if shared else table.select(*keys, F.posexplode(F.array(*(f"_v{i}" for i in range(len(columns))))).alias("_i", "_v"))
    ends, m = F.get("_b", F.col("_i"))["ends"], len(asked[0])
    below = F.size(F.filter(F.slice(ends, 1, m), lambda x: x <= F.col("_v")))
    over = F.size(F.filter(F.slice(ends, m + 1, m), lambda x: x < F.col("_v")))
    placed = each.filter("_v is not null").join(sketch, keys).select(*keys, "_i", "_v", below.alias("_below"), over.alias("_over"))
    inside = F.col("_below") > F.col("_over")
    counted = placed.groupBy(*keys, "_i", F.when(~inside, F.col("_below")).alias("_gap"), F.when(inside, F.col("_v")).alias("_value")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # the neighbours of a rank may lie outside by one place: the values at both ends of a gap are known too
    row = lambda at, order, value, c: F.struct(at.alias("_sort"), F.lit(order).alias("_order"), value.alias("_value"), c.alias("_c"))
    lo, hi, c, one = F.col("_lo"), F.col("_hi"), F.col("_c"), F.lit(1).cast("long")
    gap = F.array(row(lo, 0, lo, one), row(lo, 1, F.when(lo == hi, lo), c - 2), row(hi, 2, hi, one))
    counted = counted.select(*keys, "_i", F.inline(F.when(F.col("_gap").isNull() | (c == 1), F.array(row(lo, 0, lo, c))).otherwise(gap)))
    order = W.partitionBy(*keys, "_i").orderBy("_sort", "_order").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_c").over(order)).join(sketch, keys).withColumn("_last", F.get("_b", F.col("_i"))["n"] - 1)
    holds = lambda rank: F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank), F.col("_value")))
    parts, q = [F.first("_last").alias("_last")], []
    for j in range(m):
        at = F.col("_last") * F.get(F.array(*(F.lit(x[j]) for x in asked)), F.col("_i"))
        parts += [holds(F.floor(at)).alias(f"_l{j}"), holds(F.ceil(at)).alias(f"_h{j}")]
        low, high = F.col(f"_l{j}"), F.col(f"_h{j}")
        q.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    found = ranked.groupBy(*keys, "_i").agg(*parts).select(*keys, "_i", F.array(*q).alias("q"))
    lists = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "q"))).alias("_q"))
    place = [(0, j) if shared else (j, 0) for j in range(len(levels))]
    return sketch.select(*keys).join(lists, keys, "left").select(*keys, F.array(*(F.col("_q")[i][j] for i, j in place)).alias("q"))


def last_rows(rows: DataFrame, by: Sequence[str], n: int, time: str = "timestamp") -> DataFrame:
    """The last ``n`` rows of each key by time, without a sort of whole keys; of rows of one time, any.

    Rows are counted by key and day, which adds up before the shuffle; from the newest day back the counts name the day
    that holds the n-th row.  Only rows of that day and later are shuffled and ranked.
    """
    if n < 1:
        return rows.limit(0)
    by, day = list(by), F.to_date(F.col(time))
    days = rows.groupBy(*by, day.alias("_day")).agg(F.count("*").alias("_c"))
    newest = W.partitionBy(*by).orderBy(F.desc_nulls_last("_day")).rowsBetween(W.unboundedPreceding, -1)
    first = days.withColumn("_later", F.coalesce(F.sum("_c").over(newest), F.lit(0))).filter(F.col("_later") < n).groupBy(*by).agg(F.min("_day").alias("_first"))
    near = rows.join(first, by).filter(day >= F.col("_first")).drop("_first")
    return near.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(time)))).filter(F.col("_n") <= n).drop("_n")
