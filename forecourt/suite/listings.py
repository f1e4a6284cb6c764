"""File catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import names
from forecourt.operators import filelists
from forecourt.operators.ranking import numbered_as_sorted
from forecourt.sources.catalog import as_catalog, file_catalog
from forecourt.suite import query, views
from forecourt.suite.views import FILE_ROWS, table


def _catalog(spark, sf_dir):
    return as_catalog(views.file_rows(spark, sf_dir))


# ``{sf_dir}`` is the folder of the given tables; ``suite.all_sql`` puts it in.
@query(
    "s11_file_catalog",
    """SELECT regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '\\.[^.]*$', '') AS display_name,
              'PARQUET' AS type, size, CAST(epoch(last_modified) AS BIGINT) AS modified
       FROM read_blob('{sf_dir}/*.parquet')""",
)
def s11_file_catalog(spark, sf_dir):
    catalog = file_catalog(spark, sf_dir)
    return catalog.select(
        "display_name", "type", "size", F.unix_timestamp("modify_time").alias("modified")
    )


@query(
    "f3_f4_names",
    f"""WITH {FILE_ROWS} SELECT path, upper(regexp_extract(name, '\\.([^.]*)$', 1)) AS type,
              regexp_replace(name, '\\.[^.]*$', '') AS display_name FROM files""",
)
def f3_f4_names(spark, sf_dir):
    return _catalog(spark, sf_dir).select("path", "type", "display_name")


@query("p13_files_by_type", f"""WITH {FILE_ROWS}
    SELECT upper(regexp_extract(name, '\\.([^.]*)$', 1)) AS type, CAST(count(*) AS BIGINT) AS n_files,
           CAST(sum(size) AS BIGINT) AS total_bytes FROM files GROUP BY 1""")
def p13_files_by_type(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes")
    )


@query(
    "p14_zone_files",
    f"""WITH {FILE_ROWS} SELECT path, 'original' AS zone FROM files WHERE starts_with(path, '/original_data/')
        UNION ALL SELECT path, 'processed' FROM files WHERE starts_with(path, '/processed_data/')""",
)
def p14_zone_files(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    zones = [("original", ""), ("processed", "2")]
    first, second = (
        filelists.in_zone(catalog, wanted).select("path", F.lit(zone).alias("zone")) for zone, wanted in zones
    )
    return first.unionByName(second)


@query(
    "a11_inventory",
    f"""WITH {FILE_ROWS} SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes
        FROM files WHERE starts_with(path, '/original_data/')""",
)
def a11_inventory(spark, sf_dir):
    return filelists.inventory(filelists.in_zone(_catalog(spark, sf_dir), "original"))


@query(
    "a12_modified_today",
    f"""WITH {FILE_ROWS} SELECT CAST(count(*) AS BIGINT) AS n_files,
        CAST(count(*) FILTER (WHERE CAST(modify_time AS DATE) = DATE '2025-01-03') AS BIGINT) AS n_today FROM files""",
)
def a12_modified_today(spark, sf_dir):
    return filelists.modified_on(_catalog(spark, sf_dir), F.lit("2025-01-03"))


@query(
    "a13_size_by_type",
    """SELECT p_type AS type, round(sum(p_size + p_partkey % 100 / 100.0), 2)::DOUBLE AS used FROM part GROUP BY 1""",
)
def a13_size_by_type(spark, sf_dir):
    hundredths = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    size_text = F.concat(F.col("p_size").cast("string"), F.lit("."), hundredths, F.lit("MB"))
    files = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), size_text.alias("size_text"))
    return filelists.size_by_type(files)


@query(
    "j4_pending_files",
    f"""WITH {FILE_ROWS} SELECT CAST(count(*) AS BIGINT) AS n_pending FROM files
        WHERE name NOT IN (SELECT 'doc' || CAST(event_id % 200 AS VARCHAR) || '.csv' FROM events)""",
)
def j4_pending_files(spark, sf_dir):
    viewed = table(spark, sf_dir, "events").select(
        F.concat(F.lit("doc"), (F.col("event_id") % 200).cast("string"), F.lit(".csv")).alias("name")
    )
    return filelists.pending(_catalog(spark, sf_dir), viewed)


WANTED = f"""{FILE_ROWS}, wanted AS (
  SELECT doc_id, 'doc' || CAST(doc_id // 2 AS VARCHAR)
         || CASE WHEN doc_id % 11 = 0 THEN '.b' WHEN doc_id % 13 = 0 THEN '.csv' ELSE '' END AS wanted
  FROM documents)"""


def _wanted(spark, sf_dir):
    doc = F.col("doc_id")
    ending = F.when(doc % 11 == 0, ".b").when(doc % 13 == 0, ".csv").otherwise("")
    name = F.concat(F.lit("doc"), F.floor(doc / 2).cast("string"), ending)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("wanted"))


@query(
    "j5_resolved_names",
    f"""WITH {WANTED}, matches AS (
          SELECT w.doc_id, w.wanted, f.name,
                 CASE WHEN f.name = w.wanted THEN 0 ELSE coalesce(nullif(list_position(
                   ['txt', 'csv', 'json', 'jpg', 'png', 'pdf', 'mp3', 'mp4'],
                   substr(f.name, length(w.wanted) + 2)), 0), 99) END AS p
          FROM wanted w JOIN files f ON f.name = w.wanted OR starts_with(f.name, w.wanted || '.')),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, name) AS rn FROM matches)
        SELECT w.doc_id, w.wanted, b.name AS resolved FROM wanted w LEFT JOIN best b
        ON b.doc_id = w.doc_id AND b.rn = 1""",
)
def j5_resolved_names(spark, sf_dir):
    return filelists.resolve_names(_wanted(spark, sf_dir), _catalog(spark, sf_dir))


@query(
    "j5_resolved_downloads",
    f"""WITH {WANTED}, matches AS (
          SELECT w.doc_id, f.name, CASE WHEN f.name = w.wanted THEN 0 ELSE 1 END AS p
          FROM wanted w JOIN files f ON f.name = w.wanted OR f.name IN (w.wanted || '.csv', w.wanted || '.txt')),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, name) AS rn FROM matches)
        SELECT w.doc_id, w.wanted, b.name AS resolved FROM wanted w LEFT JOIN best b
        ON b.doc_id = w.doc_id AND b.rn = 1""",
)
def j5_resolved_downloads(spark, sf_dir):
    return filelists.resolve_names(_wanted(spark, sf_dir), _catalog(spark, sf_dir), ["csv", "txt"])


@query("t2_sorted_by_size", f"WITH {FILE_ROWS} SELECT path, name, size, modify_time FROM files")
def t2_sorted_by_size(spark, sf_dir):
    listed = filelists.sorted_by(_catalog(spark, sf_dir), "size", descending=True)
    return listed.select("path", "name", "size", "modify_time")


@query(
    "t2_order",
    f"""WITH {FILE_ROWS} SELECT size, CAST(row_number() OVER (ORDER BY size DESC) AS BIGINT) AS position FROM files""",
)
def t2_order(spark, sf_dir):
    listed = filelists.sorted_by(_catalog(spark, sf_dir), "size", descending=True)
    return numbered_as_sorted(listed, "position").select("size", "position")


@query(
    "t5_listing",
    f"""WITH {FILE_ROWS} SELECT name, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B'
             WHEN size < 1048576 THEN CAST(floor(size / 1024.0::DOUBLE * 10 + 0.5) / 10 AS VARCHAR) || ' KB'
             ELSE CAST(floor(size / 1048576.0::DOUBLE * 10 + 0.5) / 10 AS VARCHAR) || ' MB' END AS size_text,
             greatest((SELECT CAST(count(*) AS BIGINT) FROM files) - 30, 0) AS left_out
        FROM (SELECT * FROM files ORDER BY name, path LIMIT 30) f""",
)
def t5_listing(spark, sf_dir):
    return filelists.listing(_catalog(spark, sf_dir))


@query(
    "f12_safe_keys",
    f"""WITH {FILE_ROWS} SELECT regexp_replace(path, '[^a-zA-Z0-9]', '_', 'g') AS label,
              replace(path, '.', '_') AS underscored, regexp_replace(path, '[^0-9A-Za-z]', '', 'g') AS task_id,
              'dedup_' || regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g') || '_' || CAST(size AS VARCHAR) || '.csv'
              AS result_name FROM files""",
)
def f12_safe_keys(spark, sf_dir):
    path = F.col("path")
    return _catalog(spark, sf_dir).select(
        names.safe_label(path).alias("label"),
        names.dots_to_underscores(path).alias("underscored"),
        names.safe_task_id(path).alias("task_id"),
        names.result_label("dedup", F.col("name"), F.col("size")).alias("result_name"),
    )


@query(
    "s11_folders",
    f"""WITH {FILE_ROWS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(count(*) AS BIGINT) AS n_files,
              CAST(sum(size) AS BIGINT) AS total_bytes, min(name) AS first_name FROM files GROUP BY 1""",
)
def s11_folders(spark, sf_dir):
    return filelists.by_folder(_catalog(spark, sf_dir))
