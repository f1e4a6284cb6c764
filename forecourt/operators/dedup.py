"""Removing duplicate rows, keys and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.functions.text import field_at

ALL_FIELDS = "_ALL_FIELDS_"


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row deduplication; copies collapse in each task before the shuffle."""
    return df.distinct()


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``, so that the choice is repeatable.

    Planned as a per-task group limit of one row before the shuffle: a key that holds a
    third of all rows still sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(window)).filter("_copy = 1").drop("_copy")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, for batches and streams alike.

    Rows are reduced to one per key in each task before the shuffle; on a stream the state
    holds one row per key.
    """
    rest = [F.col(c) for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def dedup_columns(df: DataFrame, fields: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Deduplicate named columns given as ``a,b``, or whole rows for ``_ALL_FIELDS_``."""
    if fields == ALL_FIELDS:
        return distinct_rows(df)
    names = fields.split(",")
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    if not others:
        return distinct_rows(df)
    if order is None:
        order = others
    return first_per_key(df, [F.col(f"`{c}`") for c in names], order)


def dedup_lines(lines: DataFrame, fields: str, within: Sequence[str] = ()) -> DataFrame:
    """Deduplicate text lines by 1-based comma positions (``1,3``), keeping whole lines.

    Among lines with equal fields the smallest line is kept.  ``_ALL_FIELDS_`` compares
    whole lines.  A position beyond the line's end counts as NULL.  ``within`` names columns
    (such as the file) across which lines are never duplicates; they are kept.
    """
    if fields == ALL_FIELDS:
        return distinct_rows(lines.select("value", *within))
    keys = [field_at(F.col("value"), int(p.strip())) for p in fields.split(",")]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = lines.select("value", *within, *[k.alias(n) for k, n in zip(keys, names)])
    return keyed.groupBy(*within, *names).agg(F.min("value").alias("value")).select("value", *within)
