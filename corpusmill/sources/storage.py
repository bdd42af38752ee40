"""The shared folder of a cluster, and what is kept there while a query runs."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Our own where that is unset, in local mode only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/corpusmill-shared"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; everything under it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark)}/corpusmill-{app}-{uuid.uuid4().hex[:8]}"
        # the path object and its settings outlive the session, so that a stopped session is cleaned up after too
        system, target = file_system(spark, _SCRATCH[app])
        atexit.register(_at_exit, system, target)
    _MADE.append(f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:8]}")
    return _MADE[-1]


def _at_exit(system, target) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first, with nobody left to ask
        system.delete(target, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a URI."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path (a stopped session: leave it to the end)."""
    if spark.sparkContext._jsc is None:
        return
    system, target = file_system(spark, path)
    system.delete(target, True)
    if path in _MADE:
        _MADE.remove(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """What is stored inside goes at the end, but for the paths put into the list."""
    had, keep = set(_MADE), []
    yield keep
    for path in [p for p in _MADE if p not in had and p not in keep]:
        remove(spark, path)


def stored(spark: SparkSession, frame: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    by: columns to partition by, so that a filter on them reads no other part.
    """
    path = scratch(spark, name)
    frame.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out
