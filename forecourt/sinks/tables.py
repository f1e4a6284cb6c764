"""Result tables that can be replaced, backed up once and restored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.commits import CommitLog
from forecourt.operators.sales import MONTH_COLUMN
from forecourt.workspace import file_system, remove

# Table names and insert batch size of the platform.
TARGET_TABLE = "automobile_brand_sales_ranking"
BACKUP_TABLE = "automobile_brand_sales_ranking_backup"
INSERT_BATCH = 1000


def tables_root(spark: SparkSession) -> str:
    """Where result tables live: ``spark.forecourt.tables.dir``, else below the warehouse.

    Unlike the checkpoint folder this is kept.
    """
    root = spark.conf.get("spark.forecourt.tables.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/forecourt").rstrip("/")


def versions(spark: SparkSession, name: str) -> list[str]:
    """Committed versions of a table that are still there, oldest first: a few folders."""
    folder = f"{tables_root(spark)}/{name}"
    files, place = file_system(spark, folder)
    if not files.exists(place):
        return []
    there = {status.getPath().getName(): status.getPath().toString() for status in files.listStatus(place)}
    return [there[value] for _, value in CommitLog(spark, folder).entries() if value in there]


def table_exists(spark: SparkSession, name: str) -> bool:
    return bool(versions(spark, name))


def table_version(spark: SparkSession, name: str) -> int:
    """Number of the newest commit of a table, 0 before the first."""
    return CommitLog(spark, f"{tables_root(spark)}/{name}").latest()[0]


def open_table(spark: SparkSession, name: str) -> DataFrame:
    """The newest version of a table, also in a session that did not write it."""
    found = versions(spark, name)
    if not found:
        raise LookupError(f"no table {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{found[-1]}`")
    return spark.read.parquet(found[-1])


def replace_table(df: DataFrame, name: str, expected: int | None = None) -> int:
    """Replace a table's contents in one step; returns the number of the commit.

    The rows go to a folder of their own, which readers see once the commit log names it: a
    failed write, or a folder that is copied only in part, changes nothing.  Of two writers
    that began with the same version one is refused with ``CommitConflict``; ``expected`` is
    the version to begin with, by default that found at the call.  The version before stays
    for readers that still use it; older ones are deleted.
    """
    spark = df.sparkSession
    folder = f"{tables_root(spark)}/{name}"
    log = CommitLog(spark, folder)
    begun = log.latest()[0] if expected is None else expected
    made = f"v{begun + 1:012d}-{uuid.uuid4().hex[:12]}"
    try:
        df.write.parquet(f"{folder}/{made}")
        number = log.commit(begun, made)
    except BaseException:
        remove(spark, f"{folder}/{made}")
        raise
    open_table(spark, name)
    for old in versions(spark, name)[:-2]:
        remove(spark, old)
    log.forget_before(begun)
    return number


def drop_table(spark: SparkSession, name: str) -> None:
    """Delete a table with all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    remove(spark, f"{tables_root(spark)}/{name}")


def write_by_month(facts: DataFrame, path: str) -> None:
    """Store sales facts in one folder per month.

    Rebalancing gathers a month's rows into few files and splits a month that is too large
    for one task.
    """
    month = F.date_format("sale_date", "yyyy-MM")
    facts.withColumn(MONTH_COLUMN, month).hint("rebalance", MONTH_COLUMN).write.partitionBy(
        MONTH_COLUMN
    ).parquet(path)


def snapshot_once(spark: SparkSession, table: str, backup: str) -> bool:
    """Copy a table to its backup unless there is one already (or nothing to copy)."""
    if table_exists(spark, backup) or not table_exists(spark, table):
        return False
    replace_table(open_table(spark, table), backup)
    return True


def restore(spark: SparkSession, table: str, backup: str, columns: list[str]) -> None:
    """Put the backup's rows back; without a backup this is an error."""
    if not table_exists(spark, backup):
        raise LookupError(f"no backup table {backup}")
    replace_table(open_table(spark, backup).select(*columns), table)


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = INSERT_BATCH, **options) -> None:
    """Insert rows into a database table in batches, from all tasks at once."""
    df.write.options(**options).option("batchsize", batch).jdbc(url, table, mode="append")


def replace_jdbc(df: DataFrame, url: str, table: str, batch: int = INSERT_BATCH, **options) -> None:
    """Truncate a database table and insert the rows; grants and indexes stay."""
    df.write.options(**options).option("truncate", True).option("batchsize", batch).jdbc(
        url, table, mode="overwrite"
    )
