"""Result tables: whole scans and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def jdbc_scan(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """Database table read in ``partitions`` key ranges at once; filters are pushed down."""
    return spark.read.options(**options).jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions
    )


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row with a key value; the equality reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)
