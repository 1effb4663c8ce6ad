"""Tables that cut lineage: written once to the folder that the cluster shares, then read; and settings for long texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where staged tables go while an area is open; else each has a folder of its own.
_areas: list[str] = []
#: Arrow batches between the JVM and Python hold at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; else (tests, one machine) a folder under /tmp/checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a read of it: lost executors lose none of it.  ``keep``: outlives the
    innermost area and belongs to the one around it, if there is one."""
    areas = _areas[:-1] if keep else _areas
    path = f"{areas[-1] if areas else shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def area(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, so what is read from them must be written by then."""
    folder = f"{shared_folder(spark)}/area-{uuid.uuid4().hex}"
    _areas.append(folder)
    try:
        yield
    finally:
        _areas.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def light_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for a session that left them as they are: 10,000 long texts would fill an executor."""
    for setting, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, str(value))
