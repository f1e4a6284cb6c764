"""Intake at a pace: a streaming source that gives so many rows a second for so many seconds.

The source reads files by their line index, so an offset is a row number and a micro-batch
is a range of rows, cut to the pace by the source's own planner.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from forecourt.sources.line_index import lines_of, read_range
from forecourt.streaming.intake import intake_limits


class Rows(InputPartition):
    """Rows ``skip`` to ``skip + take - 1`` of a piece of a file."""

    def __init__(self, path: str, begin: int, end: int, skip: int, take: int, row: int):
        self.path, self.begin, self.end, self.skip, self.take, self.row = path, begin, end, skip, take, row


def _system(path: str):
    if path.startswith(("file:", "/")):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


class PacedReader(DataSourceStreamReader):
    """Plans ranges of at most ``rowsPerBatch`` rows behind the last one it has planned.

    The engine asks for the newest offset without saying where it stands, so what has been
    planned is written to ``progress`` before a batch runs and read again after a restart.
    """

    def __init__(self, options: dict):
        self.pace = int(options["rowsPerBatch"])
        if self.pace < 1:
            raise ValueError("a batch must have at least one row")
        self.most = self.pace * int(options["batches"]) if "batches" in options else None
        self.index, self.charset = options["index"], options.get("charset", "UTF-8")
        self.progress = options["progress"].rstrip("/")
        self.planned = self._restored()
        self._total: int | None = None

    def _restored(self) -> int:
        system, place = _system(f"{self.progress}/planned")
        if system.get_file_info(place).type == FileType.NotFound:
            return 0
        with system.open_input_stream(place) as file:
            return json.loads(file.read())["row"]

    def _keep(self, row: int) -> None:
        self.planned = row
        system, place = _system(f"{self.progress}/planned")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{place}.new") as file:
            file.write(json.dumps({"row": row}).encode())
        system.move(f"{place}.new", place)

    def _pieces(self):
        system, place = _system(self.index)
        return ds.dataset(place, filesystem=system, format="parquet")

    @property
    def total(self) -> int:
        if self._total is None:
            rows = self._pieces().to_table(columns=["rows"]).column("rows")
            self._total = pc.sum(rows).as_py() or 0
        return self._total

    def initialOffset(self) -> dict:
        self._keep(0)  # a new query, whatever one before it has read
        return {"row": 0}

    def latestOffset(self) -> dict:
        end = min(self.planned + self.pace, self.total)
        if self.most is not None:
            end = max(min(end, self.most), self.planned)
        return {"row": end}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        low, high = start["row"], end["row"]
        if high != self.planned:
            self._keep(high)
        at, many = ds.field("first_row"), ds.field("rows")
        wanted = (at <= high) & (at + many > low + 1) & (many > 0)
        found = []
        for r in self._pieces().to_table(filter=wanted).to_pylist():
            first, last = max(r["first_row"], low + 1), min(r["first_row"] + r["rows"] - 1, high)
            skip = r["lines"] - r["rows"] + first - r["first_row"]
            found.append(Rows(r["path"], r["begin"], r["end"], skip, last - first + 1, first))
        return found

    def read(self, partition: Rows) -> Iterator[tuple]:
        lines = lines_of(read_range(partition.path, partition.begin, partition.end))
        for i, line in enumerate(lines[partition.skip : partition.skip + partition.take]):
            yield partition.row + i, partition.path, line.decode(self.charset, "replace")

    def commit(self, end: dict) -> None:
        pass


class PacedRows(DataSource):
    """Format ``paced_rows``: rows of indexed files (see ``line_index``) as ``row``, ``path``, ``line``.

    Options: ``index`` (folder of the written index), ``progress`` (a shared folder of this
    query alone), ``rowsPerBatch``, ``batches`` (then it ends; by default all rows come),
    ``charset``.
    """

    @classmethod
    def name(cls) -> str:
        return "paced_rows"

    def schema(self) -> str:
        return "row bigint, path string, line string"

    def streamReader(self, schema) -> PacedReader:
        return PacedReader(self.options)


def paced_lines(
    spark: SparkSession, index: str, progress: str, rows_per_batch: int, batches: int | None = None, charset: str = "UTF-8"
) -> DataFrame:
    """Stream of the indexed rows, at most ``rows_per_batch`` in a micro-batch."""
    spark.dataSource.register(PacedRows)
    reader = spark.readStream.format("paced_rows").option("index", index).option("progress", progress)
    reader = reader.option("rowsPerBatch", str(rows_per_batch)).option("charset", charset)
    return (reader.option("batches", str(batches)) if batches is not None else reader).load()


def collect_paced(
    spark: SparkSession,
    index: str,
    progress: str,
    checkpoint: str,
    save: Callable[[DataFrame, int], None],
    duration: int,
    rows_per_second: int,
    charset: str = "UTF-8",
) -> StreamingQuery:
    """An intake task: so many rows a second for so many seconds, within the limits of tasks.

    A micro-batch a second is started; the task takes no more than its rows in all, also over
    restarts with the same folders.  Returns the running query; ``finish`` waits for it.
    """
    seconds, rate = intake_limits(duration, rows_per_second)
    lines = paced_lines(spark, index, progress, rate, seconds, charset)
    writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime="1 second").start()


def finish(query: StreamingQuery) -> None:
    """Wait until a paced stream has nothing more to give, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
