"""File sinks.  Output stays partitioned unless a single file is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forecourt.functions import names
from forecourt.operators.dedup import latest_per_key
from forecourt.sources.files import allow_charset

# Result names and header of the word-frequency file.
DEDUP_PREFIX = "deduplicated_"
WORD_FREQUENCY_HEADER = ["字段", "词", "频率"]

# Spark's CSV writer would cut times to milliseconds.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def dedup_path(folder: str, source: str) -> str:
    """Where the deduplicated copy of a file goes."""
    return f"{folder.rstrip('/')}/{DEDUP_PREFIX}{source.rstrip('/').rsplit('/', 1)[-1]}"


def write_csv(df: DataFrame, path: str, single_file: bool = False, charset: str = "UTF-8") -> None:
    """Headered CSV.  ``single_file`` funnels all rows through one task: small results only."""
    allow_charset(df.sparkSession, charset)
    out = df.coalesce(1) if single_file else df
    out.write.options(header=True, encoding=charset, **TIME_FORMATS).csv(path)


def write_lines(df: DataFrame, path: str, single_file: bool = False, line: str | None = None) -> None:
    """The column named by ``line``, or all columns joined with commas; a lone column as it is."""
    if line is None and len(df.columns) == 1:
        line = df.columns[0]
    whole = F.col(f"`{line}`") if line else F.concat_ws(",", *[F.col(f"`{c}`") for c in df.columns])
    out = df.select(whole.cast("string").alias("value"))
    (out.coalesce(1) if single_file else out).write.text(path)


def write_word_frequency(freq: DataFrame, path: str) -> None:
    """``字段,词,频率`` CSV from ``(field, word, freq)``; words with commas are quoted."""
    # Values are escaped as doubled quotes, so any word survives a round trip.
    named = freq.select("field", "word", "freq").toDF(*WORD_FREQUENCY_HEADER)
    named.write.option("header", True).option("escape", '"').csv(path)


def write_counts(freq: DataFrame, path: str) -> None:
    """``(word,count)`` text lines, one folder of part files."""
    line = F.concat(F.lit("("), F.col("word"), F.lit(","), F.col("freq").cast("string"), F.lit(")"))
    freq.select(line.alias("value")).write.text(path)


def write_device_json(rows: DataFrame, path: str, order: Sequence[str], folders: bool = False) -> None:
    """One JSON document per device, its newest row by ``order``, named with ``.`` as ``_``.

    Names are made safe before the newest row is chosen, so two devices whose safe names are
    equal leave one document.  Documents are lines keyed by ``device``; ``folders`` writes a
    folder per device instead, for few devices only.
    """
    named = rows.withColumn("device", names.dots_to_underscores(F.col("device")))
    latest = latest_per_key(named, ["device"], order)
    (latest.write.partitionBy("device") if folders else latest.write).json(path)
