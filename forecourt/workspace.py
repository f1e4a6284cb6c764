"""Folders for intermediate results that every executor can reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_landed: dict[tuple[str, str], str] = {}
_made: dict[str, list[str]] = {}
_landing: list[float] = []
#: Folders made in the innermost ``scratch`` of this thread; other threads have their own.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only under a local master."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="forecourt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared root that no earlier run has used."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/forecourt/{app}/{label}-{uuid.uuid4().hex[:12]}"
    if app not in _made:
        _made[app] = []
        atexit.register(_purge_at_exit, spark)
    _made[app].append(path)
    mine = _scratch.get()
    if mine is not None:
        mine.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies; a missing one is no error."""
    files, place = file_system(spark, path)
    files.delete(place, True)


def purge(spark: SparkSession) -> None:
    """Delete every intermediate folder of this application; tables read from them are gone.

    Runs by itself when the interpreter ends with a live session.  A service that stops its
    sessions calls it before.
    """
    app = spark.sparkContext.applicationId
    if _made.pop(app, None) is not None:
        remove(spark, f"{shared_root(spark)}/forecourt/{app}")
    for key in [k for k in _landed if k[0] == app]:
        del _landed[key]


def _purge_at_exit(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is not None and not context._jsc.sc().isStopped():
        purge(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate folders this thread makes inside are deleted on leaving: the work must be done by then."""
    app = spark.sparkContext.applicationId
    mine: list[str] = []
    token = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            remove(spark, path)
            if path in _made.get(app, []):
                _made[app].remove(path)
        for key in [k for k, p in _landed.items() if k[0] == app and p in mine]:
            del _landed[key]


def landed_once(spark: SparkSession, label: str, write) -> str:
    """Path written by ``write(path)``, once per application and label."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _landed:
        path = fresh_dir(spark, re.sub(r"[^A-Za-z0-9.]+", "_", label))
        start = time.perf_counter()
        write(path)
        _landing.append(time.perf_counter() - start)
        _landed[key] = path
    return _landed[key]


def landing_seconds() -> float:
    """Seconds that ``landed_once`` has spent on writing so far."""
    return sum(_landing)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table written to the shared root (this runs a job).

    Evaluated once and not again when executors are lost; readers fetch only the columns
    they use.  The copy stays until ``scratch`` is left, ``purge`` is called or the
    application ends.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
