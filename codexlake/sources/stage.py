"""Stored intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and has one machine, as in tests.
OWN_FOLDER = "/tmp/checkpoints/codexlake"

#: Paths of the tables stored within each ``scratch`` that is open, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_folder(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return given or OWN_FOLDER


def stored(df: DataFrame, name: str, lasting: bool = False, outer: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows is planned and run
    without what came before, so a lost executor costs no more than the tasks it ran. The files
    outlive the call, as the result may be read at any time; whoever owns the folder clears it. Only
    within ``scratch`` they go at its end, unless they are ``lasting``; ``outer`` ones go at the end of
    the scratch around it, if there is one."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not lasting and len(passing := _passing.get()) > outer:
        passing[-1 - outer].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table, wherever it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are deleted at the end, whether it went well or not. What is used later must have been
    stored as ``lasting`` or ``outer``, so that nothing refers to the others any more. Shuffle files go too: executors keep
    them until the driver has collected the garbage that stands for them, so it is asked to."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            removed(spark, path)
        gc.collect()
        spark._jvm.System.gc()
