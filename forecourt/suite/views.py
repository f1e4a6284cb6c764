"""Stand-ins for the platform's tables, derived from the test tables.

Every view exists twice, as a DataFrame and as the text of a SQL common table expression,
written independently for the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is taken from the file footers once, not by every query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# Stand-ins for the customer types and regions of the sales table.
SEGMENT_TYPES = {"BUILDING": "中小企业", "HOUSEHOLD": "个人", "MACHINERY": "大企业", "FURNITURE": "政府"}
REGIONS = ["北京", "上海", "广州", "深圳", "成都", "南京", "杭州"]


def car_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer_type = F.lit(None).cast("string")
    for segment, kind in SEGMENT_TYPES.items():
        customer_type = F.when(F.col("c_mktsegment") == segment, kind).otherwise(customer_type)
    region = F.col("n_name")
    for i, city in enumerate(REGIONS):
        region = F.when(F.col("n_nationkey") == i, city).otherwise(region)
    lineitem, orders, part, customer, nation = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation")
    )
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").cast("date").alias("sale_date"),
            F.when(F.col("l_orderkey") % 97 != 0, F.col("p_brand")).alias("model"),
            (F.col("l_quantity").cast("int") * 11).alias("sales_volume"),
            customer_type.alias("customer_type"),
            region.alias("region"),
            (F.round(F.col("l_discount") * 100, 1) - 2.0).alias("market_trend"),
            F.col("p_size").alias("inventory"),
            F.col("l_extendedprice").alias("revenue"),
            F.round(F.col("l_tax") * 100, 1).alias("profit_margin"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("marketing_cost"),
        )
    )


CAR_SALES = """car_sales AS (
  SELECT CAST(o.o_orderdate AS DATE) AS sale_date,
         CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE p.p_brand END AS model,
         CAST(l.l_quantity AS INT) * 11 AS sales_volume,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN '中小企业' WHEN 'HOUSEHOLD' THEN '个人'
              WHEN 'MACHINERY' THEN '大企业' WHEN 'FURNITURE' THEN '政府' END AS customer_type,
         CASE n.n_nationkey WHEN 0 THEN '北京' WHEN 1 THEN '上海' WHEN 2 THEN '广州'
              WHEN 3 THEN '深圳' WHEN 4 THEN '成都' WHEN 5 THEN '南京' WHEN 6 THEN '杭州'
              ELSE n.n_name END AS region,
         round(l.l_discount * 100, 1) - 2.0 AS market_trend,
         p.p_size AS inventory,
         l.l_extendedprice AS revenue,
         round(l.l_tax * 100, 1) AS profit_margin,
         l.l_extendedprice * l.l_discount AS marketing_cost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of about 80 messages, with tool results, tool calls and blank texts."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), F.floor(conv / 16).cast("string")).alias("session_id"),
        (conv * 100 + turn).alias("id"),
        F.when((role == "user") & (turn % 4 == 2), "tool").otherwise(role).alias("role"),
        F.when((conv + turn) % 13 == 0, "  ").otherwise(F.col("text")).alias("content"),
        F.when(
            (role == "assistant") & (turn % 4 == 1),
            F.concat(F.lit('[{"id":"c'), conv.cast("string"), F.lit('"}]')),
        ).alias("tool_calls"),
    )


CHAT = """chat AS (
  SELECT 's' || CAST(conv_id // 16 AS VARCHAR) AS session_id,
         conv_id * 100 + turn AS id,
         CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role,
         CASE WHEN (conv_id + turn) % 13 = 0 THEN '  ' ELSE text END AS content,
         CASE WHEN role = 'assistant' AND turn % 4 = 1
              THEN '[{"id":"c' || CAST(conv_id AS VARCHAR) || '"}]' END AS tool_calls
  FROM conversations)"""


def call_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streamed calls per conversation; some never get an id or a name."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("call_group"),
        (turn % 2).alias("call_index"),
        turn.alias("seq"),
        F.when((turn < 4) & (conv % 5 != 0), F.concat_ws("_", F.lit("c"), conv, turn)).alias("id"),
        F.when(turn % 4 < 2, F.concat(F.lit("tool_"), turn.cast("string"))).alias("name"),
        F.col("text").alias("fragment"),
    )


CALL_FRAGMENTS = """call_fragments AS (
  SELECT conv_id AS call_group, turn % 2 AS call_index, turn AS seq,
         CASE WHEN turn < 4 AND conv_id % 5 <> 0
              THEN 'c_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS id,
         CASE WHEN turn % 4 < 2 THEN 'tool_' || CAST(turn AS VARCHAR) END AS name,
         text AS fragment
  FROM conversations)"""


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, size, modify_time)`` of files in three folders, names of several shapes."""
    doc = F.col("doc_id")
    number = F.floor(doc / 3).cast("string")
    ending = F.element_at(
        F.array(*[F.lit(e) for e in (".csv", ".txt", ".json", "", ".b.csv", ".", ".tar.GZ")]),
        (doc % 7 + 1).cast("int"),
    )
    folder = F.element_at(
        F.array(F.lit("/original_data"), F.lit("/processed_data"), F.lit("/original_data_old")),
        (doc % 5 % 3 + 1).cast("int"),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(folder, F.lit("/doc"), number, ending).alias("path"),
        (F.col("n_chars") * (1 + doc % 50 * 40)).alias("size"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=doc * 37)).alias("modify_time"),
    )


FILE_ROWS = """file_rows AS (
  SELECT ['/original_data', '/processed_data', '/original_data_old'][doc_id % 5 % 3 + 1]
         || '/doc' || CAST(doc_id // 3 AS VARCHAR)
         || ['.csv', '.txt', '.json', '', '.b.csv', '.', '.tar.GZ'][doc_id % 7 + 1] AS path,
         n_chars * (1 + doc_id % 50 * 40) AS size,
         TIMESTAMP '2025-01-01' + to_minutes(doc_id * 37) AS modify_time
  FROM documents),
files AS (
  SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, size, modify_time FROM file_rows)"""


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of nations; every fifth is listed under another name and finds no match."""
    key = F.col("n_nationkey")
    other = F.concat(F.lit("OLD_"), "n_name")
    return table(spark, sf_dir, "nation").select(
        F.when(key % 5 == 4, other).otherwise(F.col("n_name")).alias("name"),
        (key * 2.5 + 70.0).alias("lon"),
        (key + 20.0).alias("lat"),
    )


def orders_per_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, value)``; orders are counted per customer before any join."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    per_key = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("n").alias("value"))
    )
    return per_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("name"), "value"
    )


GEO = """geo AS (
  SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'OLD_' ELSE '' END || n_name AS name,
         n_nationkey * 2.5::DOUBLE + 70 AS lon, n_nationkey + 20.0::DOUBLE AS lat
  FROM nation),
points AS (
  SELECT n_name AS name, CAST(count(*) AS BIGINT) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six measures per nation in long form."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))

    def long_form(df: DataFrame, key: str, **measured) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measured.items()]
        grouped = df.groupBy(key).agg(F.array(*entries).alias("entries"))
        return grouped.join(nation, F.col(key) == F.col("n_nationkey")).select("name", F.inline("entries"))

    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    by_customer = long_form(
        customer, "c_nationkey", d1=F.count("*"), d2=F.max("c_acctbal"), d5=F.min("c_acctbal"), d6=F.max("c_custkey")
    )
    by_supplier = long_form(supplier, "s_nationkey", d3=F.count("*"), d4=F.max("s_acctbal"))
    return by_customer.unionByName(by_supplier)


MEASURES = """wide AS (
  SELECT g.name, c.d1, c.d2, s.d3, s.d4, c.d5, c.d6
  FROM geo g
  LEFT JOIN (SELECT n_name AS name, count(*)::DOUBLE AS d1, max(c_acctbal) AS d2,
                    min(c_acctbal) AS d5, max(c_custkey)::DOUBLE AS d6
             FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) c ON c.name = g.name
  LEFT JOIN (SELECT n_name AS name, count(*)::DOUBLE AS d3, max(s_acctbal) AS d4
             FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s ON s.name = g.name)"""
