"""Grouped counts, top lists and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.text import is_blank, java_trim
from forecourt.operators.ranking import number_rows, top_rows

DEFAULT_TOP_N = 10
HUNDREDTHS = 100 * 100


def effective_top_n(top_n: int | None) -> int:
    return top_n if top_n and top_n > 0 else DEFAULT_TOP_N


def count_column(df: DataFrame, wanted: str | None) -> tuple[str, bool]:
    """The wanted column if present, else the second, else the first; and a fallback flag."""
    columns = df.columns
    if not columns:
        raise ValueError("the file has no columns")
    if wanted and wanted.strip() and wanted in columns:
        return wanted, False
    return (columns[1] if len(columns) > 1 else columns[0]), True


def _counts(df: DataFrame, key: str, weight: str | None) -> DataFrame:
    counted = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(F.col(f"`{key}`").alias("name")).agg(counted.alias("value"))


def top_counts(
    df: DataFrame, key: str, top_n: int | None = DEFAULT_TOP_N, weight: str | None = None
) -> DataFrame:
    """Row count per key, most frequent first; NULL is a key.  Ties go by key.

    ``weight`` names a column of counts for rows that were already counted once.
    """
    order = [F.col("value").desc(), F.col("name")]
    return top_rows(_counts(df, key, weight), order, effective_top_n(top_n))


def top_counts_with_total(df: DataFrame, key: str, top_n: int | None = DEFAULT_TOP_N) -> DataFrame:
    """Top counts and the number of all source rows, from one scan.

    The total is summed from the same grouped exchange instead of counting the file again.
    """
    counts = _counts(df, key, None)
    total = counts.agg(F.coalesce(F.sum("value"), F.lit(0))).scalar()
    top = top_rows(counts, [F.col("value").desc(), F.col("name")], effective_top_n(top_n))
    return top.withColumn("source_rows", total)


def drop_blank_names(top: DataFrame) -> DataFrame:
    """Remove blank names after the limit (so fewer rows may stay) and trim the others."""
    return top.filter(~is_blank(F.col("name"))).withColumn("name", java_trim(F.col("name")))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Percentage of the overall sum, two decimals; the sum is a scalar, not a window."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn("share", F.round(F.lit(100.0) * F.col(value) / total, 2))


def slice_percentages(df: DataFrame, name: str, value: str, order: list[Column]) -> DataFrame:
    """Percentages as a pie chart prints them: two decimals that add up to exactly 100.

    Every slice is cut to hundredths of a percent; the missing hundredths go, one each, to
    the slices with the largest rests (the first of ``order`` among equals).  All slices are
    numbered, however many and of whatever sign (this runs a job).  If the values sum to 0,
    every slice is 0.
    """
    total = df.agg(F.sum(value)).scalar()
    share = F.when(total == 0, F.lit(0.0)).otherwise(F.col(value) / F.nullif(total, F.lit(0)) * 100 * 100)
    cut = df.withColumn("_share", share).withColumn("_cut", F.floor("_share"))
    rest = (F.col("_share") - F.col("_cut")).desc()
    numbered = number_rows(cut.withColumn("_all", total), [rest, *order], "_n")
    missing = numbered.agg(HUNDREDTHS - F.sum("_cut")).scalar()
    raised = F.when((F.col("_all") != 0) & (F.col("_n") <= missing), 1).otherwise(0)
    return numbered.select(*df.columns, ((F.col("_cut") + raised) / F.lit(100.0)).alias("percent"))


def name_value(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.col(name).alias("name"), F.col(value).alias("value"))


def scaled(df: DataFrame, columns: list[str], divisor: float = 100.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(divisor) for c in columns})
