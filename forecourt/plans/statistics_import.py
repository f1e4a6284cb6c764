"""From a collected CSV to the brand ranking table on the dashboard, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.operators import stats
from forecourt.operators.ranking import numbered_top
from forecourt.sinks.tables import (
    BACKUP_TABLE,
    TARGET_TABLE,
    open_table,
    replace_table,
    restore,
    snapshot_once,
    table_exists,
)
from forecourt.sources.files import read_text_csv
from forecourt.workspace import stored


def import_statistics(
    spark: SparkSession,
    path: str,
    field: str | None = None,
    top_n: int | None = stats.DEFAULT_TOP_N,
    target: str = TARGET_TABLE,
    backup: str = BACKUP_TABLE,
) -> DataFrame:
    """Count a column of a CSV and replace the ranking table by the top names.

    Returns the stored names and counts with the column used, whether it was a fallback,
    and the number of source rows.  The file is scanned once.  An empty result is an error
    and leaves the table alone.
    """
    if not path or not path.strip():
        raise ValueError("the file path must not be empty")
    df = read_text_csv(spark, path)
    column, fallback = stats.count_column(df, field)
    top = stats.drop_blank_names(stats.top_counts_with_total(df, column, top_n))
    # Kept, so that the file is not counted again by every reader of the few rows.
    items = stored(
        top.select(
            "name",
            "value",
            "source_rows",
            F.lit(column).alias("field"),
            F.lit(fallback).alias("fallback_field"),
        ),
        "statistics",
    )
    if items.isEmpty():
        raise ValueError("nothing to store: the statistics are empty")
    snapshot_once(spark, target, backup)
    order = [F.col("value").desc(), F.col("name")]
    rows = numbered_top(items, order, stats.effective_top_n(top_n), "id")
    replace_table(rows.select("id", F.col("name").alias("brand_name"), F.col("value").alias("sales")), target)
    return items


def restore_statistics(spark: SparkSession, target: str = TARGET_TABLE, backup: str = BACKUP_TABLE) -> None:
    """Put the ranking back to its state before the first import."""
    columns = ["brand_name", "sales"]
    if table_exists(spark, backup) and "id" in open_table(spark, backup).columns:
        columns = ["id", *columns]
    restore(spark, target, backup, columns)
