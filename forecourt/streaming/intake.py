"""Landing dropped files, the ledger of files, and outcomes of intake tasks.

A file source hands a file to exactly one micro-batch, so per-file figures need no state
store: each batch writes its own rows under ``batch_id=<n>``, overwriting only itself when
it is retried.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from forecourt.functions import names
from forecourt.operators.dedup import first_per_key
from forecourt.sources.catalog import listed_files
from forecourt.sources.files import plain_path
from forecourt.workspace import file_system, stored

#: How much older than the newest file seen a file may be.  Far out: no file is too old.
MAX_FILE_AGE = "36500d"
#: Files that one batch of ``reconcile`` reads; it bounds the paths in the driver and the plan.
RECONCILED_FILES = 5_000

# Limits and messages of intake tasks.
MAX_DURATION = 60
DEFAULT_ROWS_PER_SECOND = 5
MAX_ROWS_PER_SECOND = 100
GRACE_SECONDS = 30
UPLOAD_FAILED = "数据已通过 Socket 接收，但写入 HDFS 失败，请检查 HDFS 连接状态"
TIMED_OUT = "采集超时：无法连接数据源 %s:%s，请确认采集服务端已启动（本机监听端口 %s）"


def intake_limits(duration: int, rows_per_second: int) -> tuple[int, int]:
    """Effective seconds and rows per second of a task; at least one second is needed."""
    if duration < 1:
        raise ValueError("the duration must be at least one second")
    rate = DEFAULT_ROWS_PER_SECOND if rows_per_second < 1 else rows_per_second
    return min(duration, MAX_DURATION), min(rate, MAX_ROWS_PER_SECOND)


def paced(reader, max_files: int | None, archive: str | None = None):
    """Take files of any age, at most ``max_files`` in one micro-batch.

    By default a file source passes over files a week older than the newest it has seen; see
    ``MAX_FILE_AGE``.  ``archive`` moves files there once they are done, which bounds the log
    of seen files and lets a name come again.
    """
    reader = reader.option("maxFileAge", MAX_FILE_AGE)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def dropped_rows(
    spark: SparkSession, landing: str, schema: str, max_files: int | None = None, archive: str | None = None
) -> DataFrame:
    """Stream of the rows of headered CSV files, each with its file name."""
    reader = paced(spark.readStream.schema(schema).option("header", True), max_files, archive)
    return reader.csv(landing).withColumn("source_file", F.col("_metadata.file_name"))


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """Take what has arrived and stop, or go on in steps such as ``10 seconds``."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def land(rows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append everything that arrives to Parquet, exactly once."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return triggered(writer.outputMode("append"), every).start(out)


def dropped_lines(
    spark: SparkSession, landing: str, max_files: int | None = None, archive: str | None = None
) -> DataFrame:
    return _with_file(paced(spark.readStream.option("lineSep", "\n"), max_files, archive).text(landing))


def _unescaped(c: Column) -> Column:
    """Spark's file columns escape names as in a URL."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _with_file(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        _unescaped(F.col("_metadata.file_name")).alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("receive_time"),
    )


def file_records(lines: DataFrame) -> DataFrame:
    """One record per file: size and number of data rows (newlines minus the header).

    Line lengths that add up to more than the file show a last line without newline.
    """
    n_bytes = F.sum((F.octet_length("value") + 1).cast("bigint"))
    return (
        lines.groupBy("file_name", "file_path", "file_size", "receive_time")
        .agg(F.count("*").alias("n_lines"), n_bytes.alias("n_bytes"))
        .withColumn("open_end", (F.col("file_size") - F.col("n_bytes")).isin(-1, 2).cast("int"))
        .select(
            "file_name",
            "file_path",
            "file_size",
            F.greatest(F.col("n_lines") - F.col("open_end") - 1, F.lit(0)).alias("data_count"),
            "receive_time",
            F.lit(True).alias("upload_success"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def failed(records: DataFrame, error: str = UPLOAD_FAILED) -> DataFrame:
    """The same records for files that were received but could not be stored."""
    return records.withColumns({"upload_success": F.lit(False), "error": F.lit(error)})


def keep_ledger(
    lines: DataFrame,
    ledger: str,
    checkpoint: str,
    every: str | None = None,
    store: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Add the records of newly arrived files to the ledger table.

    ``store(lines, batch_id)`` may put the contents somewhere; if it fails, the files of the
    batch get records with ``upload_success`` false and an error, and the stream goes on.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        records = file_records(batch)
        if store is not None:
            batch.persist()
            try:
                store(batch, batch_id)
            except Exception:  # whatever the store raises is an upload that failed
                records = failed(records)
        records.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")
        batch.unpersist()

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return triggered(writer, every).start()


def reconcile(spark: SparkSession, folders: str | Sequence[str], ledger: str) -> int:
    """Enter files that the stream cannot see: empty ones, and those sent again under one path.

    The folders' complete listing is compared with the ledger by path and time; what is
    missing is read in one batch per ``RECONCILED_FILES`` files and added to the ledger in a
    folder of its own.  Run it between batches.  Names that begin with ``_`` or ``.`` are
    listed by the catalog but are no uploads.  Returns the number of records added.
    """
    from forecourt.streaming.state import read_batches  # it builds on this module

    files = listed_files(spark, folders).filter(~F.regexp_extract("path", "([^/]*)$", 1).rlike("^[_.]"))
    files = files.withColumn("key", plain_path(F.replace(F.col("path"), F.lit("%"), F.lit("%25"))))
    known = read_batches(spark, ledger) if file_system(spark, ledger)[0].exists(file_system(spark, ledger)[1]) else None
    if known is not None and known.columns:
        seen = known.select(plain_path(F.col("file_path")).alias("key"), F.col("receive_time").alias("modify_time"))
        files = files.join(seen, ["key", "modify_time"], "left_anti")
    missing = stored(files, "missing")
    last = -1 if known is None else (known.agg(F.min("batch_id").cast("long")).first()[0] or 0)
    number, added = min(last, 0) - 1, 0
    empty = missing.filter("size = 0").select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"),
        F.col("path").alias("file_path"),
        F.col("size").alias("file_size"),
        F.lit(0).cast("bigint").alias("data_count"),
        F.col("modify_time").alias("receive_time"),
        F.lit(True).alias("upload_success"),
        F.lit(None).cast("string").alias("error"),
    )
    paths = (r["path"] for r in missing.filter("size > 0").select("path").toLocalIterator())
    while chunk := list(itertools.islice(paths, RECONCILED_FILES)):
        lines = _with_file(spark.read.option("lineSep", "\n").text(chunk))
        file_records(lines).write.mode("overwrite").parquet(f"{ledger}/batch_id={number}")
        number, added = number - 1, added + len(chunk)
    if not empty.isEmpty():
        empty.write.mode("overwrite").parquet(f"{ledger}/batch_id={number}")
        added += empty.count()
    return added


def current_records(ledger: DataFrame) -> DataFrame:
    """The latest record of each file name."""
    return first_per_key(ledger, ["file_name"], [F.col("receive_time").desc(), F.col("file_path").desc()])


def intake_totals(ledger: DataFrame) -> DataFrame:
    """Files and bytes received, and the file received last."""
    moment = F.struct("receive_time", "file_path")
    return ledger.agg(
        F.count("*").alias("received_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("received_bytes"),
        F.max_by("file_name", moment).alias("last_file_name"),
        F.max_by("file_path", moment).alias("last_file_path"),
    )


def outcomes(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Status of intake tasks ``(task_id, file_name, address, deadline)`` against records.

    A task succeeds when its file was received by the deadline and stored; a file that was
    received but not stored, or nothing by the deadline, is an error.
    """
    seen = records.select("file_name", "file_size", "data_count", "receive_time", "upload_success", *[c for c in records.columns if c == "error"])
    return _verdicts(tasks.join(seen, "file_name", "left"))


def _verdicts(joined: DataFrame, *more: str) -> DataFrame:
    """Tasks with their records (or NULL) as outcomes."""
    error = F.coalesce("error", F.lit(UPLOAD_FAILED)) if "error" in joined.columns else F.lit(UPLOAD_FAILED)
    in_time = F.col("receive_time").isNotNull() & (F.col("receive_time") <= F.col("deadline"))
    stored = in_time & F.col("upload_success")

    source = F.col("address")
    timed_out = F.format_string(
        TIMED_OUT, names.host(source), names.port(source), F.lit(names.DEFAULT_PORT)
    )

    def when_received(c: str) -> Column:
        return F.when(in_time, F.col(c)).alias(c)

    return joined.select(
        "task_id",
        "file_name",
        F.when(stored, "success").otherwise("error").alias("status"),
        when_received("data_count"),
        F.when(stored, F.col("file_size")).alias("file_size"),
        F.when(stored, F.lit(None).cast("string"))
        .when(in_time, error)
        .otherwise(timed_out)
        .alias("message"),
        *more,
    )


def deadline(start: Column, duration: Column) -> Column:
    """When a task that began at ``start`` counts as timed out; its duration is cut to the limit."""
    seconds = F.least(duration.cast("int"), F.lit(MAX_DURATION)) + F.lit(GRACE_SECONDS)
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def late_outcomes(tasks: DataFrame, records: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Stream of outcomes of a stream of tasks against a stream of records, each as soon as it is known.

    Tasks have ``task_id``, ``file_name``, ``address``, ``start`` and ``deadline`` (see ``deadline``),
    records the columns of the ledger.  A record that arrives in time gives its outcome at
    once.  A task without one is said to be late by the stream itself, when both streams'
    time has passed the longest deadline a task can have by ``delay``; its state is dropped
    with that.  A record after the deadline changes nothing.  A file received twice in time
    gives a row each.  Tasks and records that come more than ``delay`` behind their stream's
    newest are not taken.
    """
    longest = f"INTERVAL {MAX_DURATION + GRACE_SECONDS} SECONDS"
    started = tasks.withWatermark("start", delay)
    seen = records.withColumnRenamed("file_name", "_received").withWatermark("receive_time", delay)
    in_time = F.expr(
        f"file_name = _received AND receive_time >= start AND receive_time <= start + {longest} AND receive_time <= deadline"
    )
    return _verdicts(started.join(seen, in_time, "left_outer"), "start")
