"""Map, share and rank tables of the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.operators import geo, ranking, stats
from forecourt.suite import query, views
from forecourt.suite.views import GEO, MEASURES, table


@query(
    "a14_share",
    """SELECT o_orderpriority AS name, CAST(count(*) AS BIGINT) AS value,
              round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share
       FROM orders GROUP BY 1""",
)
def a14_share(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"))
    return stats.share_of_total(counts.agg(F.count("*").alias("value")), "value")


@query(
    "a14_slice_percentages",
    """WITH slices AS (SELECT s_suppkey AS name, CAST(s_acctbal * 100 AS BIGINT) AS value FROM supplier),
       cut AS (SELECT *, value / sum(value) OVER () * 100 * 100 AS share FROM slices),
       placed AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, name) AS n,
                         10000 - sum(floor(share)) OVER () AS missing FROM cut)
       SELECT name, value, (floor(share) + CASE WHEN n <= missing THEN 1 ELSE 0 END) / 100 AS percent FROM placed""",
)
def a14_slice_percentages(spark, sf_dir):
    balance = F.round(F.col("s_acctbal") * 100).cast("bigint")
    slices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), balance.alias("value"))
    return stats.slice_percentages(slices, "name", "value", [F.col("name")])


@query(
    "a14_many_slices",
    """WITH slices AS (SELECT l_orderkey * 10 + l_linenumber AS name,
                              CAST(round(l_extendedprice * 100) AS BIGINT) AS value FROM lineitem),
       cut AS (SELECT *, value / sum(value) OVER () * 100 * 100 AS share FROM slices),
       placed AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, name) AS n,
                         10000 - sum(floor(share)) OVER () AS missing FROM cut)
       SELECT name, value, (floor(share) + CASE WHEN n <= missing THEN 1 ELSE 0 END) / 100 AS percent FROM placed""",
)
def a14_many_slices(spark, sf_dir):
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    name = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("name")
    slices = table(spark, sf_dir, "lineitem").select(name, price.alias("value"))
    return stats.slice_percentages(slices, "name", "value", [F.col("name")])


@query(
    "p6_name_value",
    "SELECT p_name AS name, p_retailprice AS value FROM part",
)
def p6_name_value(spark, sf_dir):
    return stats.name_value(table(spark, sf_dir, "part"), "p_name", "p_retailprice")


@query(
    "p7_unit_scaling",
    "SELECT p_partkey, p_retailprice / 100 AS p_retailprice, p_size / 100.0::DOUBLE AS p_size FROM part",
)
def p7_unit_scaling(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return stats.scaled(part, ["p_retailprice", "p_size"])


@query(
    "w2_display_rank",
    """SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier""",
)
def w2_display_rank(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ranking.number_rows(supplier, [F.col("s_suppkey")], "rank")


@query(
    "w3_rank_label",
    f"""WITH {GEO}, numbered AS (
          SELECT *, row_number() OVER (ORDER BY value DESC, name) - 1 AS place FROM points)
        SELECT name, value, CASE WHEN place < 10 THEN '0' ELSE '' END || CAST(place AS VARCHAR) || name AS rank_label
        FROM numbered""",
)
def w3_rank_label(spark, sf_dir):
    return ranking.rank_labels(views.orders_per_nation(spark, sf_dir), "value", "name")


@query(
    "j1_coordinates",
    f"""WITH {GEO} SELECT p.name, g.lon, g.lat, CAST(p.value AS DOUBLE) AS value
        FROM points p JOIN geo g ON p.name = g.name""",
)
def j1_coordinates(spark, sf_dir):
    points = geo.with_coordinates(views.orders_per_nation(spark, sf_dir), views.geo(spark, sf_dir))
    point = F.col("point")
    return points.select("name", point[0].alias("lon"), point[1].alias("lat"), point[2].alias("value"))


@query(
    "t4_top_points",
    f"""WITH {GEO}, top AS (SELECT * FROM points ORDER BY value DESC, name LIMIT 20)
        SELECT p.name, g.lon, g.lat, CAST(p.value AS DOUBLE) AS value FROM top p JOIN geo g ON p.name = g.name""",
)
def t4_top_points(spark, sf_dir):
    points = geo.top_points(views.orders_per_nation(spark, sf_dir), views.geo(spark, sf_dir))
    point = F.col("point")
    return points.select("name", point[0].alias("lon"), point[1].alias("lat"), point[2].alias("value"))


@query(
    "j2_flows",
    f"""WITH {GEO} SELECT o.lon AS from_lon, o.lat AS from_lat, p.name AS to_name, g.lon AS to_lon,
               g.lat AS to_lat, p.value
        FROM points p JOIN geo g ON p.name = g.name, geo o WHERE o.name = 'NATION_3'""",
)
def j2_flows(spark, sf_dir):
    return geo.flow_lines(views.orders_per_nation(spark, sf_dir), views.geo(spark, sf_dir), "NATION_3")


NAMES = ["d1", "d2", "d3", "d4", "d5", "d6"]
SLIDES = [("d1", "d1"), ("d1", "d2"), ("d3", "d3"), ("d3", "d4"), ("d5", "d5"), ("d5", "d6")]


@query(
    "j3_measures",
    f"""WITH {GEO}, {MEASURES} SELECT name, d1 / 100 AS d1, d2 / 100 AS d2, d3 / 100 AS d3, d4 / 100 AS d4,
        d5 / 100 AS d5, d6 / 100 AS d6 FROM wide""",
)
def j3_measures(spark, sf_dir):
    wide = geo.align_measures(views.geo(spark, sf_dir), views.measures(spark, sf_dir), NAMES)
    return stats.scaled(wide, NAMES)


SLIDE_ROWS = """slides AS (
      SELECT 0 AS slide, name, d1 AS value, d1 AS shown FROM wide
      UNION ALL SELECT 1, name, d1, d2 FROM wide UNION ALL SELECT 2, name, d3, d3 FROM wide
      UNION ALL SELECT 3, name, d3, d4 FROM wide UNION ALL SELECT 4, name, d5, d5 FROM wide
      UNION ALL SELECT 5, name, d5, d6 FROM wide)"""


@query(
    "t6_bar_rows",
    f"""WITH {GEO}, {MEASURES}, {SLIDE_ROWS}
    SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY value NULLS FIRST, name) AS place,
           name, value, shown FROM slides""",
)
def t6_bar_rows(spark, sf_dir):
    wide = geo.align_measures(views.geo(spark, sf_dir), views.measures(spark, sf_dir), NAMES)
    return geo.bar_rows(geo.slide_rows(wide, SLIDES))


@query(
    "t6_bar_arrays",
    f"""WITH {GEO}, {MEASURES}, {SLIDE_ROWS}
    SELECT slide, string_agg(name, ';' ORDER BY value NULLS FIRST, name) AS labels,
           string_agg(coalesce(CAST(CAST(shown * 100 AS BIGINT) AS VARCHAR), '-'), ';'
                      ORDER BY value NULLS FIRST, name) AS bar_values
    FROM slides GROUP BY slide""",
)
def t6_bar_arrays(spark, sf_dir):
    wide = geo.align_measures(views.geo(spark, sf_dir), views.measures(spark, sf_dir), NAMES)
    bars = geo.bar_arrays(geo.slide_rows(wide, SLIDES))
    shown = F.transform(
        "bar_values", lambda v: F.coalesce(F.round(v * 100).cast("bigint").cast("string"), F.lit("-"))
    )
    return bars.select(
        "slide", F.array_join("labels", ";").alias("labels"), F.array_join(shown, ";").alias("bar_values")
    )
