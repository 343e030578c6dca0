"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(app: str = "sceneloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    A temporary folder is set only where that is unset and the master is local (tests).
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = os.path.join(tempfile.gettempdir(), f"sceneloom-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", where)
    atexit.register(shutil.rmtree, where, True)
    return where


_written: list[str] = []  # folders that this process wrote for itself and that are still there


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it is removed by ``clear``, at the end of ``scratch``, or when the process ends."""
    if not _written:
        atexit.register(lambda: clear(spark))
    _written.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders written since the ``since``-th, on whatever file system they are."""
    for path in _written[since:]:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone, and a folder left behind harms nobody
            pass
    del _written[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what queries inside wrote for themselves; for use around a query and the action that consumes its result."""
    since = len(_written)
    try:
        yield
    finally:
        clear(spark, since)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation; being columnar
    and compressed, it is smaller than an RDD checkpoint and keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Rounds:
    """The written tables of an iteration, one folder each, read together as one scan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n, self.schema = spark, scratch_path(spark, "rounds"), 0, None

    def add(self, df: DataFrame, open_rows: Column) -> int:
        """Write the next table; returns how many of its rows are open, counted while they are written."""
        seen = Observation()
        self.schema = df.schema
        df.observe(seen, F.count_if(open_rows).alias("n")).write.parquet(f"{self.base}/{self.n}")
        self.n += 1
        return seen.get["n"]

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{self.n - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.base}/{k}" for k in range(self.n)))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan that came in fewer partitions than there are cores one partition per core.

    Only raises the count, so inputs with many files keep their own splits and shuffle nothing.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
