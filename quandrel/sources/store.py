"""Runs on disk: forecasts, parameters, metrics and configuration as Parquet; a manifest, written last, makes a run visible whole.

Layout: ``root/<kind>/run=<run>/version=<id>/...`` holds data that is never changed, and ``root/manifests/<run>/<n>.json``
names the version of each kind.  Readers go by the highest n of a run, so they see all of a commit or nothing of it; what a
broken write left behind has no manifest.  Two writers that commit the same n collide, and the later one fails.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("forecasts", "params", "states", "metrics", "config")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all machines share; under /tmp only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that a commit needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def put(self, path: str, text: str) -> None:
        """A new file, whole or not at all; an error if there is one already."""
        draft = self.path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(draft, self.path(path)):
            self.fs.delete(draft, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def manifests(spark: SparkSession, root: str) -> dict[str, tuple[int, dict[str, str]]]:
    """run -> (number, version of each kind): the newest manifest of every run.  One small file a run is read."""
    files = Files(spark, root)
    newest = {}
    for run in files.names(f"{root}/manifests"):
        numbers = [n for n in files.names(f"{root}/manifests/{run}") if n.endswith(".json")]
        if numbers:
            newest[run] = numbers[-1]
    if not newest:
        return {}
    read = spark.read.option("wholetext", True).text([f"{root}/manifests/{run}/{n}" for run, n in newest.items()]).collect()
    said = [json.loads(r.value) for r in read]
    return {m["run"]: (m["number"], m["kinds"]) for m in said}


class Run:
    """What one commit of a run writes.  Kinds that it doesn't write keep the version of the run's last commit."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.spark, self.root, self.run, self.kinds = spark, root, run, {}
        self.number, self.before = manifests(spark, root).get(run, (0, {}))

    def save(self, rows: DataFrame, kind: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"a kind is one of {KINDS}")
        version = uuid.uuid4().hex
        by = ["model"] if "model" in rows.columns else []
        rows.write.partitionBy(*by).parquet(f"{self.root}/{kind}/run={self.run}/version={version}")
        self.kinds[kind] = version

    def save_config(self, config: dict) -> None:
        """The configuration as JSON, times as ISO text."""
        self.save(self.spark.createDataFrame([(json.dumps(config, default=str, sort_keys=True),)], "config string"), "config")

    def commit(self) -> None:
        said = {"run": self.run, "number": self.number + 1, "kinds": self.before | self.kinds}
        Files(self.spark, self.root).put(f"{self.root}/manifests/{self.run}/{self.number + 1:012d}.json", json.dumps(said, sort_keys=True))


@contextmanager
def writing(spark: SparkSession, root: str, run: str) -> Iterator[Run]:
    """A commit of all that is saved inside; an error inside leaves the run as it was."""
    one = Run(spark, root, run)
    yield one
    one.commit()


def save(rows: DataFrame, root: str, kind: str, run: str) -> None:
    """Commit one kind of a run (of KINDS); a kind that is written again is replaced, other kinds and runs stay."""
    with writing(rows.sparkSession, root, run) as one:
        one.save(rows, kind)


def load(spark: SparkSession, root: str, kind: str, run: str | None = None) -> DataFrame:
    """All runs of a kind, or one, lazily; filters on run and model prune folders."""
    found = {name: kinds[kind] for name, (_, kinds) in manifests(spark, root).items() if kind in kinds and run in (None, name)}
    if not found:
        raise ValueError(f"no {kind} of {'any run' if run is None else f'run {run!r}'}")
    paths = [f"{root}/{kind}/run={name}/version={version}" for name, version in found.items()]
    return spark.read.option("basePath", f"{root}/{kind}").option("mergeSchema", True).parquet(*paths).drop("version")


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete versions that no newest manifest names, and return their folders; not while others write or read old versions."""
    files, kept, gone = Files(spark, root), manifests(spark, root), []
    for kind in KINDS:
        for run in files.names(f"{root}/{kind}"):
            for version in files.names(f"{root}/{kind}/{run}"):
                if kept.get(run.removeprefix("run="), (0, {}))[1].get(kind) != version.removeprefix("version="):
                    gone.append(f"{root}/{kind}/{run}/{version}")
                    files.delete(gone[-1])
    return gone


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """Forecasts of all runs with key, run and model joined by '_'."""
    return load(spark, root, "forecasts").withColumn("key", F.concat_ws("_", "run", "model"))


def save_report(spark: SparkSession, root: str, run: str, config: dict, metrics: DataFrame) -> None:
    """Commit a run's metrics and configuration together."""
    with writing(spark, root, run) as one:
        one.save(metrics, "metrics")
        one.save_config(config)


def load_config(spark: SparkSession, root: str, run: str) -> dict:
    return json.loads(load(spark, root, "config", run).first().config)


def params_of(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The run's parameters, to apply to new forecasts without a fit."""
    return load(spark, root, "params", run).drop("run")


def state_of(spark: SparkSession, root: str, run: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(predictor's parameters, postprocessor's parameters) of one commit: what a run needs to forecast without any fit."""
    _, kinds = manifests(spark, root).get(run, (0, {}))
    return tuple(load(spark, root, kind, run).drop("run") if kind in kinds else None for kind in ("states", "params"))
