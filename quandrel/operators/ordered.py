"""Order inside long keys: range partitions cut sorted rows into bounded blocks, and small tables carry state over their bounds.

No window here spans a whole key, so one series of any length fills as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quandrel.sources.store import scratch_folder

#: A block holds 2^12 rows at most, a run of blocks 2^12 blocks.
BLOCK_BITS = RUN_BITS = 12


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: row order and partition bounds are fixed, and lost executors lose none of it."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(rows: DataFrame, by: list[str], order: list[str | Column], cut: list[str | Column] | None = None, at: str = "_at") -> DataFrame:
    """``rows`` as a written table with ``at``, which rises in the order of ``by`` and ``order``.

    Rows go to range partitions by ``by`` and ``cut`` (``order`` itself by default; a prefix of long columns keeps the
    sampled bounds small), so that one key may fill many.  ``at`` is consecutive inside a partition and jumps to a multiple
    of 2^33 at its end, so ``at >> b`` names blocks of at most 2^b neighbours.
    """
    dealt = rows.repartitionByRange(*by, *(cut or order)).sortWithinPartitions(*by, *order)
    return written(dealt.withColumn(at, F.monotonically_increasing_id()), "ordered")


def before(blocks: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """``blocks`` (by, block, n) with ``before``: the sum of n over the earlier blocks of the key.

    Runs of blocks are summed first, so a window holds the blocks of one run, or the runs of one key.
    """
    dealt = blocks.withColumn("_run", F.shiftright("block", RUN_BITS))
    sums = dealt.groupBy(*by, "_run").agg(F.sum(n).alias("_n"))
    earlier = lambda value, *keys: F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy("_run" if value == "_n" else "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, "_run", earlier("_n", *by).alias("_start"))
    return dealt.join(starts, [*by, "_run"]).withColumn("before", F.col("_start") + earlier(n, *by, "_run")).drop("_run", "_start")
