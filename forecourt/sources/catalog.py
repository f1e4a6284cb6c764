"""File listings as tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.functions import names
from forecourt.sources.listing import can_list, file_type, listing
from forecourt.workspace import file_system, fresh_dir


_FILES = "path STRING, size LONG, modify_time TIMESTAMP"
_CHUNK = 10_000


def listed_files(spark: SparkSession, folders: str | Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
    """``path``, ``size``, ``modify_time`` of every file directly in the folders.

    Empty files and names that begin with ``_`` or ``.`` are files too, though Spark's own
    sources pass them over, so the folders are listed by a source of their own, in tasks (see
    ``listing``), and what they hold is written to the shared folder once: a listing does not
    change while it is used.  ``types`` (upper case, as ``as_catalog`` gives them) leaves others
    out where they are listed.  Contents are not read.  A missing folder is an error.

    Where only the JVM reaches a file system, its entries come through the driver, which holds
    a chunk of them at a time.
    """
    if isinstance(folders, str):
        folders = [f.strip() for f in folders.split(",") if f.strip()]
    by_system: dict[str, bool] = {}
    in_tasks, here = [], []
    for folder in folders:
        files, place = file_system(spark, folder.rstrip("/") or "/")
        whole = files.makeQualified(place).toString()
        system = files.getUri().toString()
        if system not in by_system:
            by_system[system] = can_list(whole)
        (in_tasks if by_system[system] else here).append(whole)
    out = fresh_dir(spark, "listing")
    if in_tasks or not here:
        found = listing(spark, in_tasks)
        if types is not None:
            found = found.filter(F.col("type").isin(list(types)))
        found.select("path", "size", "modify_time").write.mode("append").parquet(out)
    if here:
        _list_here(spark, here, types, out)
    return spark.read.schema(_FILES).parquet(out)


def _list_here(spark: SparkSession, folders: Sequence[str], types: Sequence[str] | None, out: str) -> None:
    """Lists in the driver, entry by entry, and writes a chunk at a time."""
    held: list[tuple[str, int, datetime]] = []

    def write() -> None:
        spark.createDataFrame(held, _FILES).coalesce(1).write.mode("append").parquet(out)
        held.clear()

    for folder in folders:
        files, place = file_system(spark, folder)
        entries = files.listStatusIterator(place)
        while entries.hasNext():
            entry = entries.next()
            if not entry.isDirectory() and (types is None or file_type(entry.getPath().getName()) in types):
                moment = datetime.fromtimestamp(entry.getModificationTime() / 1000, timezone.utc)
                held.append((entry.getPath().toString(), entry.getLen(), moment))
                if len(held) == _CHUNK:
                    write()
    write()


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file or a folder with a visible file at any depth (stops at the first)."""
    files, place = file_system(spark, path)
    if not files.exists(place):
        return False
    entries = files.listFiles(place, True)
    while entries.hasNext():
        if not entries.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def file_catalog(spark: SparkSession, folders: str | Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
    """Files directly in the folders (a list, or one comma-separated text), of all or some types; runs a job."""
    return as_catalog(listed_files(spark, folders, types))


def as_catalog(files: DataFrame) -> DataFrame:
    """Add folder, name, name without extension and upper-case type to ``(path, size, modify_time)``."""
    name = names.file_name(F.col("path"))
    return files.select(
        "path",
        names.folder(F.col("path")).alias("folder"),
        name.alias("name"),
        names.base_name(name).alias("display_name"),
        names.file_type(name).alias("type"),
        "size",
        "modify_time",
    )
