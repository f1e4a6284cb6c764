"""Where lines begin in files, so that any page of lines costs that page.

The index has a row per piece of a file of about a megabyte: the bytes of the lines that
begin in it and how many there are.  It is made in tasks that read pieces side by side; a
page then reads the pieces that hold it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.workspace import stored

PIECE_BYTES = 1 << 20
_PIECES = "path string, size bigint, begin bigint, first bigint, lines bigint"


def read_range(path: str, begin: int, end: int) -> bytes:
    """Bytes ``begin`` to ``end`` of a file named as the catalog names it."""
    if path.startswith(("file:", "/")):
        system, place = LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, place = FileSystem.from_uri(quote(path, safe=":/"))
    with system.open_input_file(place) as file:
        return file.read_at(max(0, end - begin), begin)


def _first_lines(batches: Iterable[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """For each piece the first byte of a line that begins in it, and how many lines do."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            begin, end = r["begin"], min(r["begin"] + piece, r["size"])
            # A line begins at 0 and behind every newline but a last one.
            data = np.frombuffer(read_range(r["path"], max(begin - 1, 0), end - 1), np.uint8)
            starts = np.flatnonzero(data == 0x0A) + 1 + max(begin - 1, 0)
            if begin == 0:
                starts = np.append(0, starts)
            if len(starts):
                rows.append((r["path"], r["size"], begin, int(starts[0]), len(starts)))
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "size", "begin", "first", "lines"])


def line_index(files: DataFrame, header: int = 0, piece: int = PIECE_BYTES) -> DataFrame:
    """Index of ``files`` (``path``, ``size``, as the catalog lists them); runs a job, and is written.

    ``begin`` and ``end`` are the bytes of the lines that begin in a piece, ``lines`` their number,
    ``first_line`` that of the first in its file, from 1.  ``first_row`` numbers lines over all
    files by path, from 1, without the first ``header`` lines of each; ``rows`` is how many of
    the piece's lines these are.  Empty files have no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(piece).cast("bigint")))
    pieces = files.filter("size > 0").select("path", F.col("size").cast("bigint").alias("size"), starts.alias("begin"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "path", "begin")
    found = stored(dealt.mapInArrow(lambda batches: _first_lines(batches, piece), _PIECES), "line_pieces")
    file = Window.partitionBy("path").orderBy("begin")
    before = F.coalesce(F.sum("lines").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.select(
        "path",
        F.col("first").alias("begin"),
        F.coalesce(F.lead("first").over(file), F.col("size")).alias("end"),
        "lines",
        (before + 1).alias("first_line"),
    )
    skipped = F.least(F.greatest(F.lit(header) + 1 - F.col("first_line"), F.lit(0)), F.col("lines"))
    numbered = numbered.withColumn("rows", F.col("lines") - skipped)
    # Files, not lines, are summed up in order here.
    of_file = numbered.groupBy("path").agg(F.sum("rows").alias("n"))
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_file.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    earlier = F.greatest(F.col("first_line") - 1 - F.lit(header), F.lit(0))
    index = numbered.join(offsets, "path").withColumn("first_row", F.col("offset") + earlier + 1).drop("offset")
    return stored(index.orderBy("first_row", "begin"), "line_index")


def lines_of(data: bytes) -> list[bytes]:
    """Lines without their ends."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [line.removesuffix(b"\r") for line in lines]


def _read(pieces: DataFrame, charset: str) -> DataFrame:
    """Lines of the pieces: ``path``, ``position`` in the file, ``row`` over all files, ``line``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lines = [line.decode(charset, "replace") for line in lines_of(read_range(r["path"], r["begin"], r["end"]))]
                skipped = r["lines"] - r["rows"]
                rows = [r["first_row"] + i - skipped if i >= skipped else None for i in range(len(lines))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["path"]] * len(lines), pa.string()),
                        pa.array(range(r["first_line"], r["first_line"] + len(lines)), pa.int64()),
                        pa.array(rows, pa.int64()),
                        pa.array(lines, pa.string()),
                    ],
                    names=["path", "position", "row", "line"],
                )

    return pieces.mapInArrow(run, "path string, position bigint, row bigint, line string")


def page_pieces(index: DataFrame, first: int, count: int, by: str = "line") -> DataFrame:
    """Rows of the index that hold lines (of each file) or rows (over all files) ``first`` to ``first + count - 1``."""
    begins, many = ("first_line", "lines") if by == "line" else ("first_row", "rows")
    return index.filter((F.col(begins) < first + count) & (F.col(begins) + F.col(many) > first))


def page_of_lines(index: DataFrame, first: int, count: int, charset: str = "UTF-8") -> DataFrame:
    """``path``, ``position``, ``line``: lines ``first`` to ``first + count - 1`` of each indexed file."""
    found = _read(page_pieces(index, first, count), charset).drop("row")
    return found.filter((F.col("position") >= first) & (F.col("position") < first + count))


def page_of_rows(index: DataFrame, first: int, count: int, charset: str = "UTF-8") -> DataFrame:
    """``row``, ``path``, ``line``: rows ``first`` to ``first + count - 1`` over all indexed files."""
    found = _read(page_pieces(index, first, count, "row"), charset).select("row", "path", "line")
    return found.filter((F.col("row") >= first) & (F.col("row") < first + count))
