"""Map and chart tables: coordinates, flow lines, aligned measures, bar data.

Joins carry no broadcast hint but for the starts of slides, one row per slide that the code
lists: Spark broadcasts a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forecourt.operators.ranking import number_rows, top_rows


def with_coordinates(points: DataFrame, geo: DataFrame) -> DataFrame:
    """``(name, value)`` with ``[lon, lat, value]``; names without coordinates drop out."""
    coordinates = F.array(F.col("lon"), F.col("lat"), F.col("value").cast("double"))
    return points.join(geo, "name").select("name", coordinates.alias("point"))


def top_points(points: DataFrame, geo: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest points, then their coordinates; those without drop out, so fewer may stay."""
    return with_coordinates(top_rows(points, [F.col("value").desc(), F.col("name")], n), geo)


def flow_lines(points: DataFrame, geo: DataFrame, origin: str) -> DataFrame:
    """Lines from one named origin to every point with known coordinates.

    The origin is one scalar, so no row pairs are formed for it and its two coordinates come
    from one row: of several rows of that name the one with the smallest longitude, then
    latitude.  An unknown origin, or one that lacks a coordinate, gives no lines.
    """
    place = F.struct("lon", "lat")
    known = geo.filter((F.col("name") == origin) & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    start = known.agg(F.min(place).alias("start")).scalar()
    return (
        points.join(geo, "name")
        .withColumn("_start", start)
        .filter(F.col("_start").isNotNull())
        .select(
            F.col("_start.lon").alias("from_lon"),
            F.col("_start.lat").alias("from_lat"),
            F.col("name").alias("to_name"),
            F.col("lon").alias("to_lon"),
            F.col("lat").alias("to_lat"),
            "value",
        )
    )


def align_measures(geo: DataFrame, measures: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per map name with a column per measure; missing measures are NULL.

    ``measures`` is long, ``(name, measure, value)``, so all measures meet in one grouping
    and one join instead of a join per measure.
    """
    wide = measures.groupBy("name").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in names]
    )
    return geo.select("name").join(wide, "name", "left")


def slide_rows(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(slide, name, value, shown)`` from measure columns: slide i sorts by one, shows one."""
    slides = [
        F.struct(F.lit(i).alias("slide"), F.col(v).alias("value"), F.col(s).alias("shown"))
        for i, (v, s) in enumerate(pairs)
    ]
    return wide.select("name", F.inline(F.array(*slides))).select("slide", "name", "value", "shown")


def bar_rows(slides: DataFrame) -> DataFrame:
    """Bars with their place on the slide, by ascending value and name.

    Numbered over all slides at once, so that a slide is never sorted by one task; the
    first number of each slide turns that into places.  Those are one row per slide of a list
    given in code, so they are broadcast and no bar is shuffled to its slide.
    """
    order = [F.col("slide"), F.col("value"), F.col("name")]
    numbered = number_rows(slides, order, "_n")
    first = numbered.groupBy("slide").agg(F.min("_n").alias("_first"))
    place = (F.col("_n") - F.col("_first") + 1).alias("place")
    return numbered.join(F.broadcast(first), "slide").select("slide", place, "name", "value", "shown")


def bar_arrays(slides: DataFrame) -> DataFrame:
    """Per slide, value and label arrays aligned by ascending value, for a chart.

    Input ``(slide, name, value, shown)``: ordered by ``value``, drawn with ``shown``.  Each
    array is one value; ``bar_rows`` gives the same order as rows for name lists of any size.
    """
    bars = F.array_sort(F.collect_list(F.struct("value", "name", "shown")))
    return slides.groupBy("slide").agg(bars.alias("bars")).select(
        "slide",
        F.col("bars.name").alias("labels"),
        F.col("bars.shown").alias("bar_values"),
    )
