"""Numbering, top lists and last-n-per-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.workspace import stored


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in a global order, without pulling all rows into one task.

    The rows are range-sorted and numbered as they then lie.  ``order`` should be unique,
    else tied rows get their numbers in no particular order.
    """
    return numbered_as_sorted(df.orderBy(*order), name, start)


def numbered_as_sorted(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the order that ``df``, the result of a sort, already has.

    The rows are written once (this runs a job) together with their partition and their
    place in it; a row's number is its place plus the sizes of the partitions before.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(df.withColumns({"_part": F.spark_partition_id(), "_place": in_partition}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the window and the broadcast are bounded by that number.
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    number = F.col("_offset") + F.col("_place") + start
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, number.alias(name))


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of a global order (each task keeps at most ``n``)."""
    return df.orderBy(*order).limit(n)


def numbered_top(df: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """Top ``n`` with 1-based numbers; the window sees at most ``n`` rows."""
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return top_rows(df, order, n).withColumn(name, place)


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "back"
) -> DataFrame:
    """First ``n`` rows of each key in ``order``, numbered from 1.

    Up to the session setting ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by
    default) Spark cuts each key to ``n`` rows in every task before the shuffle, so one hot
    key sends at most ``n`` rows per task.  For a larger ``n`` rows are range-sorted by key
    and ``order`` instead (this runs a job), and no task holds a key whole.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return _first_in_ranges(df, keys, order, n, name)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def _first_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """``last_per_key`` for any ``n``: numbers come from places in a global sort.

    A row's number is its place among its key's rows in its partition plus how many rows of
    the key the partitions before hold.  Partitions that begin behind the ``n`` th row of a
    key are left out before the join, which goes by key and partition.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*keys, *order)
    placed = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_place": in_partition}), "placed_in_key")
    runs = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_from"), F.count("*").alias("_size"))
    # One row per key and partition that has rows of it: about keys + partitions in all.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).filter(F.col("_before") < n)
    runs = runs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_run"), "_from", "_before")
    same = F.col("_part") == F.col("_run")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    number = (F.col("_before") + F.col("_place") - F.col("_from") + 1).cast("int")
    return placed.join(runs, same).select(*df.columns, number.alias(name)).filter(F.col(name) <= n)


def rank_labels(df: DataFrame, value: str, label: str) -> DataFrame:
    """Chart labels by descending value: ``00name`` ... ``09name``, ``10name``."""
    numbered = number_rows(df, [F.col(value).desc(), F.col(label)], "_place", start=0)
    place = F.col("_place").cast("string")
    padded = F.when(F.col("_place") < 10, F.concat(F.lit("0"), place)).otherwise(place)
    return numbered.withColumn("rank_label", F.concat(padded, F.col(label))).drop("_place")
