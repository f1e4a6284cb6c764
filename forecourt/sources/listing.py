"""Files of folders as a batch source: each task lists some of the folders."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: More folders than this share tasks.
MOST_TASKS = 2_000


class Folders(InputPartition):
    """Folders that one task lists."""

    def __init__(self, folders: list[str]):
        self.folders = folders


def file_type(name: str) -> str:
    """Upper-case text after the last dot, '' without one."""
    return name.rpartition(".")[2].upper() if "." in name else ""


def _moment(nanoseconds: int | None) -> datetime | None:
    """To the millisecond, as Hadoop's file systems tell it."""
    if nanoseconds is None:
        return None
    seconds, rest = divmod(nanoseconds // 1_000_000, 1000)
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest * 1000)


def _local_entries(place: str) -> Iterator[tuple[str, int, int]]:
    """Name, size and time of the files in a folder, one at a time; a file has one without a name."""
    if not os.path.isdir(place):
        found = os.stat(place)  # raises where there is nothing
        yield "", found.st_size, found.st_mtime_ns
        return
    with os.scandir(place) as entries:
        for entry in entries:
            if entry.name.startswith(".") and entry.name.endswith(".crc"):
                continue  # a checksum that Hadoop keeps beside a file
            try:
                if not entry.is_dir():
                    found = entry.stat()
                    yield entry.name, found.st_size, found.st_mtime_ns
            except FileNotFoundError:
                continue  # gone since the folder was opened, or a link to nothing


def _entries(folder: str) -> Iterator[tuple[str, int, int | None]]:
    if folder.startswith("file:"):
        yield from _local_entries("/" + folder.removeprefix("file:").lstrip("/"))
        return
    system, place = FileSystem.from_uri(folder)
    itself = system.get_file_info(place)
    if itself.type == FileType.File:
        yield "", itself.size, itself.mtime_ns
        return
    for info in system.get_file_info(FileSelector(place)):
        if info.type != FileType.Directory:
            yield info.base_name, info.size, info.mtime_ns


class ListingReader(DataSourceReader):
    """Leaves out folders, and files of other types, that a filter on ``folder`` or ``type`` rules out."""

    def __init__(self, options: dict):
        self.folders: list[str] = json.loads(options["folders"])
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("folder",), ("type",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if f.attribute == ("folder",):
                    self.folders = [p for p in self.folders if p in wanted]
                else:
                    self.types = wanted if self.types is None else self.types & wanted
            else:
                yield f

    def partitions(self) -> list[Folders]:
        tasks = min(len(self.folders), MOST_TASKS)
        return [Folders(self.folders[i::tasks]) for i in range(tasks)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            for name, size, changed in _entries(folder):
                path = f"{folder.rstrip('/')}/{name}" if name else folder
                # A name that is no UTF-8 is shown as Hadoop shows it.
                path = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                kind = file_type(path.rpartition("/")[2])
                if self.types is None or kind in self.types:
                    yield path, size, _moment(changed), folder, kind


class FileListing(DataSource):
    """Format ``file_listing``: ``path``, ``size``, ``modify_time``, ``folder``, ``type`` of files.

    Option ``folders``: a JSON list of qualified paths (``file:/...``, ``hdfs://...``).  Empty and
    hidden files are files too; folders inside are not entered.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, size bigint, modify_time timestamp, folder string, type string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def can_list(folder: str) -> bool:
    """Whether tasks reach the file system of a qualified path without the JVM."""
    if folder.startswith("file:"):
        return True
    try:
        system, place = FileSystem.from_uri(folder)
        return system.get_file_info(place).type != FileType.NotFound
    except (ValueError, OSError):  # a scheme Arrow has no client for, or none that is set up here
        return False


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Lists when it is run, a task for each folder (or for several, see ``MOST_TASKS``).

    Filters on ``folder`` and ``type`` by equality or ``IN`` reach the source: folders that are
    ruled out are not opened.  A folder that does not exist is an error of the job.
    """
    spark.dataSource.register(FileListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("file_listing").option("folders", json.dumps(folders)).load()
