"""Number coercion and display rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_or_zero(c: Column) -> Column:
    """Whole number of a text or number column.

    Numbers lose their fraction; NULL and text that is not a whole number count as 0.
    """
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def double_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def round_half_up_1(c: Column) -> Column:
    """One decimal, ties towards +infinity (so -2.25 gives -2.2, unlike ``round``)."""
    return F.floor(c.cast("double") * 10 + 0.5) / F.lit(10.0)


def fixed_2(c: Column) -> Column:
    """Two decimals of the exact binary value, ties away from zero, no digit grouping."""
    x = c.cast("double")
    cents = F.abs(x * 100)
    tie = ((x * 8) == F.floor(x * 8)) & ((cents - F.floor(cents)) == 0.5)
    nudged = F.when(tie, x + F.signum(x) * 0.001).otherwise(x)
    return F.call_function("format_number", nudged, F.lit("0.00"))


def human_size(n: Column) -> Column:
    """Bytes as ``n B``, ``x.y KB`` below one MiB, else ``x.y MB``."""
    size = n.cast("bigint")
    kib = round_half_up_1(size / F.lit(1024.0))
    mib = round_half_up_1(size / F.lit(1024.0 * 1024.0))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(kib.cast("string"), F.lit(" KB")))
        .otherwise(F.concat(mib.cast("string"), F.lit(" MB")))
    )


def leading_number(c: Column) -> Column:
    """Numeric prefix of texts such as ``3.21MB``; NULL when there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
