"""CSV and text files, their fields and their charsets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forecourt.functions.text import field_at
from forecourt.operators.ranking import number_rows
from forecourt.workspace import file_system

# Candidate charsets in order of preference, and the characters that reject
# a candidate (control characters but tab, CR and LF; U+FFFD and above).
CHARSETS = ["UTF-8", "GBK", "GB2312", "windows-1252"]
REJECTED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}-\x{FFFF}]"
ORIGINAL_CHARSET = "GBK"
PROCESSED_CHARSET = "UTF-8"

_SPARK_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}
_ANY_CHARSET = "spark.sql.legacy.javaCharsets"
_REPLACE_MALFORMED = "spark.sql.legacy.codingErrorAction"


def allow_charset(spark: SparkSession, charset: str) -> None:
    """Spark 4 reads and writes charsets such as GBK only with this session setting."""
    if charset.lower() not in _SPARK_CHARSETS:
        spark.conf.set(_ANY_CHARSET, "true")


@contextmanager
def _java_charsets(spark: SparkSession):
    """While columns are resolved inside: ``decode`` takes any charset and never fails."""
    before = {k: spark.conf.get(k, None) for k in (_ANY_CHARSET, _REPLACE_MALFORMED)}
    try:
        for key in before:
            spark.conf.set(key, "true")
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | None = None,
    charset: str = "UTF-8",
    infer: bool = False,
) -> DataFrame:
    """CSV with a header.  Give a schema: inferring types costs a second scan.

    Without a schema and without ``infer`` all columns are strings.
    """
    allow_charset(spark, charset)
    reader = spark.read.option("header", True).option("encoding", charset)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def read_text_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with every column as text; a file without columns is an error."""
    df = read_csv(spark, paths)
    if not df.columns:
        raise ValueError("the file has no columns")
    return df


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of one or several files or folders, column ``value``."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths))


def path_list(paths: str) -> list[str]:
    """Paths of a comma-separated list."""
    return [p.strip() for p in paths.split(",") if p.strip()]


def positions(text: str) -> list[int]:
    return [int(p.strip()) for p in text.split(",")]


def positional(lines: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Comma-separated fields by 1-based position as ``field0``, ``field1``, ..."""
    return lines.select(
        *[field_at(F.col("value"), p).alias(f"field{i}") for i, p in enumerate(wanted)]
    )


def file_kind(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_by_extension(
    spark: SparkSession, path: str, charset: str = "UTF-8", infer: bool = False, schema: str | None = None
) -> DataFrame:
    """``.csv`` as headered table, ``.txt`` as lines; other extensions are an error."""
    kind = file_kind(path)
    if kind == "csv":
        return read_csv(spark, path, schema=schema, charset=charset, infer=infer)
    if kind == "txt":
        return read_lines(spark, path)
    raise ValueError(f"unsupported file format: {kind or path}")


def preview_fields(spark: SparkSession, path: str, charset: str = "UTF-8") -> list[str]:
    """Header names of a CSV, ``1..n`` for a text file (from its first line), else nothing.

    Trailing empty fields of a text line do not count.
    """
    kind = file_kind(path)
    if kind == "csv":
        return read_csv(spark, path, charset=charset).columns
    if kind == "txt":
        first = read_lines(spark, path).head()
        if first is None:
            return []
        line = first["value"]
        fields = line.rstrip(",").split(",") if line.strip(",") or not line else []
        return [str(i + 1) for i in range(len(fields))]
    return []


def _raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Newline-separated raw lines with the path and size of their file."""
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place"),
        "value",
    )


def _fits(charset: str) -> Column:
    """Whether a raw line decodes in a charset without rejected characters."""
    raw = F.col("value").cast("binary")
    text = F.col("value") if charset == "UTF-8" else F.decode(raw, charset)
    return ~text.rlike(REJECTED)


def detect_charsets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, charset)``: the first candidate that decodes the whole file.

    Every line is judged where it is read and the verdicts are combined per file, so a
    large file is split over tasks and never becomes one value.  (No candidate uses a
    newline byte inside a longer character.)  The reader drops a UTF-8 byte order mark,
    which shows as bytes missing from the sum of line lengths; a marked file is UTF-8.
    """
    return described_files(spark, paths).select("path", "charset")


def described_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, charset, plain, header)`` of every file, from one pass; the header is the raw first line.

    A ``plain`` file is ASCII without a mark: it reads alike in every candidate, so it says
    nothing about the charset of the files beside it (a part file without rows has only the
    header).
    """
    lines = _raw_lines(spark, paths).select(
        "path",
        "file_size",
        "place",
        "value",
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        (~F.col("value").rlike(r"[^\x00-\x7F]")).alias("plain"),
        _fits(CHARSETS[0]).alias("ok0"),
    )
    with _java_charsets(spark):
        # All candidates agree on plain ASCII, so only other lines are decoded again.
        judged = lines.withColumns(
            {
                f"ok{i}": F.when(F.col("plain"), F.col("ok0")).otherwise(_fits(c))
                for i, c in enumerate(CHARSETS[1:], start=1)
            }
        )
    per_file = judged.groupBy("path", "file_size").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.min_by("value", "place").alias("header"),
        F.bool_and("plain").alias("plain"),
        *[F.bool_and(f"ok{i}").alias(f"ok{i}") for i in range(len(CHARSETS))],
    )
    missing = F.col("file_size") - F.col("n_bytes")  # 3, or 2 without a last newline
    marked = missing.isin(2, 3)
    chosen = F.when(marked, F.lit(CHARSETS[0]))
    for i, charset in enumerate(CHARSETS):
        chosen = chosen.when(F.col(f"ok{i}"), F.lit(charset))
    return per_file.select(
        "path",
        chosen.otherwise(F.lit(CHARSETS[0])).alias("charset"),
        (F.col("plain") & ~marked).alias("plain"),
        F.rtrim(F.col("header"), F.lit("\r")).alias("header"),
    )


def common_charsets(found: Iterable[tuple[str, bool]]) -> set[str]:
    """The different charsets among ``(charset, plain)`` of files; plain ones agree with any other."""
    files = set(found)
    return {charset for charset, plain in files if not plain} or {charset for charset, _ in files}


def plain_path(c: Column) -> Column:
    """One spelling of the path in a file column: ``file:///x`` is ``file:/x``, escapes are undone."""
    unescaped = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(unescaped, "^([A-Za-z0-9]+):/+", "$1:/")


def given_paths(spark: SparkSession, files: DataFrame, given: Sequence[str]) -> DataFrame:
    """``files`` (``path``) with ``given``: the place in the list of the path that holds the file.

    Every folder above a file is offered as a key, so this is an equality join, whatever the
    number of paths.
    """
    rows = []
    for i, path in enumerate(given):
        system, place = file_system(spark, path)
        rows.append((i, re.sub("^([A-Za-z0-9]+):/+", r"\1:/", system.makeQualified(place).toString())))
    named = spark.createDataFrame(rows, "given int, named string")
    parts = F.split("_plain", "/")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    keyed = files.withColumn("_plain", plain_path(F.col("path"))).withColumn("named", above)
    return keyed.join(named, "named").drop("named", "_plain")


def charset_of(spark: SparkSession, path: str) -> str:
    """Charset of one file or folder (runs a job); an empty file counts as UTF-8."""
    found = described_files(spark, path).select("charset", "plain").distinct().collect()
    charsets = common_charsets((r["charset"], r["plain"]) for r in found)
    if len(charsets) > 1:
        raise ValueError(f"files under {path} have different charsets")
    return charsets.pop() if charsets else CHARSETS[0]


def preview_lines(spark: SparkSession, paths: str | Sequence[str], charset: str) -> DataFrame:
    """``(path, position, line)``: the whole text of files in a charset, malformed bytes as U+FFFD.

    Positions count a file's lines from 1, so its text can be put together again.  They are
    found without gathering a file in one task (this runs a job).
    """
    lines = _raw_lines(spark, paths)
    line = F.regexp_replace("value", "\r$", "")
    with _java_charsets(spark):
        if charset.upper() != "UTF-8":
            line = F.regexp_replace(F.decode(F.col("value").cast("binary"), charset), "\r$", "")
        decoded = lines.select("path", "place", line.alias("line"))
        numbered = number_rows(decoded, [F.col("path"), F.col("place.block"), F.col("place.id")], "_n")
    first = numbered.groupBy("path").agg(F.min("_n").alias("_first"))
    return numbered.join(first, "path").select("path", (F.col("_n") - F.col("_first") + 1).alias("position"), "line")


def preview_original(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return preview_lines(spark, paths, ORIGINAL_CHARSET)


def preview_processed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return preview_lines(spark, paths, PROCESSED_CHARSET)
