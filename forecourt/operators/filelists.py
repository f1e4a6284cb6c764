"""Operators over the file catalog ``(path, name, type, size, modify_time)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions import names
from forecourt.functions.numbers import human_size, leading_number
from forecourt.operators.ranking import top_rows

# Lookup order of extensions, download types and the listing length.
LOOKUP_EXTENSIONS = ["txt", "csv", "json", "jpg", "png", "pdf", "mp3", "mp4"]
LISTED_FILES = 30


def in_zone(catalog: DataFrame, zone: str) -> DataFrame:
    """Files of a zone; ``processed`` or ``2`` is the processed zone, else the original."""
    processed = zone is not None and (zone.lower() == "processed" or zone == "2")
    folder = names.PROCESSED_ZONE if processed else names.ORIGINAL_ZONE
    return catalog.filter(names.in_zone(F.col("path"), folder))


def inventory(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")
    )


def modified_on(catalog: DataFrame, day: Column) -> DataFrame:
    """Files in all and files modified on a day (half-open)."""
    start = day.cast("timestamp_ntz")
    moment = F.col("modify_time")
    return catalog.agg(
        F.count("*").alias("n_files"),
        F.count_if((moment >= start) & (moment < start + F.expr("INTERVAL 1 DAY"))).alias("n_today"),
    )


def pending(catalog: DataFrame, viewed: DataFrame) -> DataFrame:
    """Number of files whose name has not been viewed.

    A name that was viewed a million times counts as one row of the anti join.
    """
    seen = viewed.select("name").distinct()
    counts = catalog.groupBy("name").agg(F.count("*").alias("copies"))
    return counts.join(seen, "name", "left_anti").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_pending")
    )


def size_by_type(files: DataFrame) -> DataFrame:
    """Sum of size texts such as ``3.21MB`` per storage type, two decimals."""
    return files.groupBy("type").agg(
        F.round(F.sum(leading_number(F.col("size_text"))), 2).alias("used")
    )


def resolve_names(wanted: DataFrame, catalog: DataFrame, extensions=None) -> DataFrame:
    """File for each wanted name: the exact name, else by extension order, else any.

    "Any" is a file called ``<wanted>.<something>``, the first by name.  Every file offers
    each of its dot-prefixes as a key, and the best file per key is chosen before the
    join, so the join is on equality with one row per key.  With ``extensions``, only files
    whose rest after the wanted name is one of them are offered.
    """
    name = F.col("name")
    parts = F.split(name, r"\.")
    # Number of leading parts in each key; the whole name is the exact match.
    key = F.array_join(F.slice(parts, F.lit(1), F.col("n")), ".")
    offers = (
        catalog.select(name)
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts))))
        .select(name, key.alias("key"))
        .withColumn("rest", F.expr("substr(name, length(key) + 2)"))
        .withColumn("exact", F.col("key") == name)
    )
    order = F.array_position(F.array(*[F.lit(e) for e in LOOKUP_EXTENSIONS]), F.col("rest"))
    if extensions is None:
        priority = F.when(F.col("exact"), 0).when(order > 0, order).otherwise(99)
    else:
        offers = offers.filter(F.col("exact") | F.col("rest").isin(list(extensions)))
        priority = F.when(F.col("exact"), 0).otherwise(99)
    best = offers.groupBy("key").agg(
        F.min(F.struct(priority.alias("p"), name.alias("file"))).alias("best")
    )
    joined = wanted.join(best, wanted["wanted"] == best["key"], "left")
    return joined.select(wanted["*"], F.col("best.file").alias("resolved"))


def sorted_by(catalog: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Listing sorted by name, size or time, ties by path."""
    if column not in ("name", "size", "modify_time", "type"):
        raise ValueError(f"cannot sort files by {column}")
    c = F.col(column)
    return catalog.orderBy(c.desc() if descending else c.asc(), F.col("path"))


def listing(catalog: DataFrame, n: int = LISTED_FILES) -> DataFrame:
    """First ``n`` files by name with readable sizes, and how many are left out."""
    left_out = catalog.agg(F.greatest(F.count("*") - n, F.lit(0))).scalar()
    first = top_rows(catalog.select("name", "path", "size"), [F.col("name"), F.col("path")], n)
    return first.select(
        "name", human_size(F.col("size")).alias("size_text"), left_out.alias("left_out")
    )


def by_folder(catalog: DataFrame) -> DataFrame:
    """Files, bytes and first name per folder; the files themselves stay rows of the catalog."""
    return catalog.groupBy("folder").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"), F.min("name").alias("first_name")
    )
