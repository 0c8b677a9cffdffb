"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: losing an executor afterwards repeats no earlier work, and
``monotonically_increasing_id`` columns stay what they were when the table was written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: list[str] = []
_SCOPES: list[list[tuple]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on a single machine (tests, a laptop), a fresh local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        folder = _OWN[0]
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema.

    The folder is deleted when the application ends, or with the ``scope`` that it was staged in, or by ``discard``.
    ``free``: the shuffle files of the write are deleted at its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    for staged in _SCOPES[-1:]:
        staged.append((files, place))
    staged_table = spark.read.schema(df.schema).parquet(path)
    staged_table._staged = (files, place)
    return staged_table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for files, place in (t._staged for t in tables):
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


@contextmanager
def scope() -> Iterator[None]:
    """What is staged inside is deleted at the end, for applications that go on for long; results must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for files, place in _SCOPES.pop():
            files.delete(place, True)
            files.cancelDeleteOnExit(place)


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must to tell."""
    return len(df.select().limit(limit + 1).take(limit + 1)) <= limit if limit < 1000 else df.count() <= limit


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
