"""Sales queries, summaries and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import schemas
from forecourt.operators import sales
from forecourt.operators.ranking import numbered_as_sorted
from forecourt.plans import sales_report
from forecourt.sinks import tables
from forecourt.suite import query
from forecourt.suite.views import CAR_SALES, car_sales
from forecourt.workspace import landed_once

FACTS = (
    "sale_date, model, sales_volume, customer_type, region, market_trend, inventory, revenue, "
    "profit_margin, marketing_cost"
)


def _period_sql(where: str) -> str:
    return f"WITH {CAR_SALES} SELECT {FACTS} FROM car_sales WHERE {where}"


@query("p3_sales_day", _period_sql("sale_date = DATE '1996-03-15'"))
def p3_sales_day(spark, sf_dir):
    return sales.sales_of(car_sales(spark, sf_dir), "1996-03-15")


@query("p3_sales_month", _period_sql("sale_date >= DATE '1996-03-01' AND sale_date < DATE '1996-04-01'"))
def p3_sales_month(spark, sf_dir):
    return sales.sales_of(car_sales(spark, sf_dir), "1996-03")


@query("p3_sales_year", _period_sql("sale_date >= DATE '1996-01-01' AND sale_date < DATE '1997-01-01'"))
def p3_sales_year(spark, sf_dir):
    return sales.sales_of(car_sales(spark, sf_dir), "1996")


@query(
    "t1_order",
    f"""WITH {CAR_SALES} SELECT model, CAST(row_number() OVER (ORDER BY model NULLS FIRST) AS BIGINT) AS position FROM car_sales
        WHERE sale_date >= DATE '1996-01-01' AND sale_date < DATE '1997-01-01'""",
)
def t1_order(spark, sf_dir):
    ordered = sales.sales_of(car_sales(spark, sf_dir), "1996")
    return numbered_as_sorted(ordered, "position").select("model", "position")


@query("p3_month_folders", _period_sql("sale_date >= DATE '1996-03-01' AND sale_date < DATE '1996-04-01'"))
def p3_month_folders(spark, sf_dir):
    path = landed_once(
        spark, f"{sf_dir}/car_sales", lambda p: tables.write_by_month(car_sales(spark, sf_dir), p)
    )
    schema = f"{schemas.CAR_SALES}, {sales.MONTH_COLUMN} STRING"
    return sales.sales_of(spark.read.schema(schema).parquet(path), "1996-03").drop(sales.MONTH_COLUMN)


# Fixed values in the SQL below: names, separators and report texts of the platform.
BY_MODEL = """by_model AS (
  SELECT coalesce(model, '未知车型') AS model, CAST(sum(sales_volume) AS BIGINT) AS volume,
         CAST(sum(inventory) AS BIGINT) AS inventory, CAST(count(*) AS BIGINT) AS n_rows,
         floor(avg(market_trend) * 10 + 0.5) / 10 AS avg_trend
  FROM car_sales GROUP BY 1)"""


@query("a7_sales_by_model", f"WITH {CAR_SALES}, {BY_MODEL} SELECT * FROM by_model")
def a7_sales_by_model(spark, sf_dir):
    return sales.by_model(car_sales(spark, sf_dir))


@query(
    "w1_ranked_models",
    f"""WITH {CAR_SALES}, {BY_MODEL}
        SELECT *, row_number() OVER (ORDER BY volume DESC, model) AS rank FROM by_model""",
)
def w1_ranked_models(spark, sf_dir):
    return sales.ranked_models(car_sales(spark, sf_dir))


@query(
    "a8_sales_totals",
    f"""WITH {CAR_SALES}
        SELECT CAST(sum(sales_volume) AS BIGINT) AS total_volume,
               CAST(sum(inventory) AS BIGINT) AS total_inventory, CAST(count(*) AS BIGINT) AS n_rows,
               CAST(count(DISTINCT coalesce(model, '未知车型')) AS BIGINT) AS n_models FROM car_sales""",
)
def a8_sales_totals(spark, sf_dir):
    return sales.totals(car_sales(spark, sf_dir))


@query(
    "a9_coverage",
    f"""WITH {CAR_SALES}
        SELECT string_agg(DISTINCT region, '、' ORDER BY region) AS regions,
               string_agg(DISTINCT customer_type, '、' ORDER BY customer_type) AS customer_types FROM car_sales""",
)
def a9_coverage(spark, sf_dir):
    return sales.coverage(car_sales(spark, sf_dir))


@query(
    "a9_coverage_rows",
    f"""WITH {CAR_SALES}
        SELECT 'region' AS kind, region AS value FROM car_sales WHERE region IS NOT NULL GROUP BY region
        UNION ALL SELECT 'customer_type', customer_type FROM car_sales WHERE customer_type IS NOT NULL GROUP BY customer_type""",
)
def a9_coverage_rows(spark, sf_dir):
    return sales.coverage_rows(car_sales(spark, sf_dir))


PLAN = f"""{CAR_SALES}, targets AS (
  SELECT *, CAST(trunc(CAST(sales_volume AS FLOAT) *
           (CAST(1 AS FLOAT) + CAST(market_trend AS FLOAT) / CAST(100 AS FLOAT))) AS BIGINT) AS target_sales,
         CAST(trunc(sales_volume * 0.1::DOUBLE) AS BIGINT) AS safety_stock FROM car_sales),
plan AS (
  SELECT sale_date, model, CAST(sales_volume AS BIGINT) AS sales_volume, customer_type, region,
         market_trend, CAST(inventory AS BIGINT) AS inventory, target_sales,
         target_sales - sales_volume AS additional_sales, safety_stock,
         inventory + target_sales - sales_volume + safety_stock AS suggested_inventory,
         (target_sales - sales_volume) * 50 AS marketing_cost_plan,
         (target_sales - sales_volume) * 20 AS discount_cost_plan,
         (target_sales - sales_volume) * 70 AS total_cost_plan,
         CASE customer_type WHEN '中小企业' THEN '批量采购享 5% 折扣' WHEN '个人' THEN '首购客户享 10% 折扣'
              WHEN '大企业' THEN '企业客户赠送一年保养服务' WHEN '政府' THEN '政府采购提供定制化服务'
              ELSE '常规促销活动' END AS marketing_action,
         CASE WHEN region IN ('北京', '上海', '广州', '深圳') THEN '线上广告'
              WHEN region IN ('成都', '南京', '杭州') THEN '线下车展' ELSE '本地经销商活动' END AS promotion_method,
         CASE WHEN sales_volume > 300 THEN '4S店' ELSE '电商平台' END AS sales_channel
  FROM targets)"""


@query("p9_sales_plan", f"WITH {PLAN} SELECT * FROM plan")
def p9_sales_plan(spark, sf_dir):
    return sales.sales_plan(car_sales(spark, sf_dir)).drop("revenue", "profit_margin", "marketing_cost")


@query(
    "a10_plan_totals",
    f"""WITH {PLAN} SELECT CAST(sum(target_sales) AS BIGINT) AS total_target_sales,
        CAST(sum(total_cost_plan) AS BIGINT) AS total_budget FROM plan""",
)
def a10_plan_totals(spark, sf_dir):
    return sales.plan_totals(sales.sales_plan(car_sales(spark, sf_dir)))


def _plan_counts_sql(column: str) -> str:
    return f"WITH {PLAN} SELECT {column}, CAST(count(*) AS BIGINT) AS n FROM plan GROUP BY 1"


@query("p10_marketing_action", _plan_counts_sql("marketing_action"))
def p10_marketing_action(spark, sf_dir):
    facts = car_sales(spark, sf_dir)
    action = sales.marketing_action(F.col("customer_type")).alias("marketing_action")
    return facts.groupBy(action).agg(F.count("*").alias("n"))


@query("p11_promotion_method", _plan_counts_sql("promotion_method"))
def p11_promotion_method(spark, sf_dir):
    facts = car_sales(spark, sf_dir)
    method = sales.promotion_method(F.col("region")).alias("promotion_method")
    return facts.groupBy(method).agg(F.count("*").alias("n"))


@query("p12_sales_channel", _plan_counts_sql("sales_channel"))
def p12_sales_channel(spark, sf_dir):
    facts = car_sales(spark, sf_dir)
    channel = sales.sales_channel(F.col("sales_volume")).alias("sales_channel")
    return facts.groupBy(channel).agg(F.count("*").alias("n"))


@query(
    "p8_null_model",
    f"""WITH {CAR_SALES} SELECT coalesce(model, '未知车型') AS model, CAST(count(*) AS BIGINT) AS n
        FROM car_sales GROUP BY 1""",
)
def p8_null_model(spark, sf_dir):
    model = sales.model_or_unknown(F.col("model")).alias("model")
    return car_sales(spark, sf_dir).groupBy(model).agg(F.count("*").alias("n"))


PERIOD = "sale_date >= DATE '1996-03-01' AND sale_date < DATE '1996-04-01'"


def _summary_sql(extra: str = "") -> str:
    return f"""WITH {CAR_SALES}, period AS (SELECT * FROM car_sales WHERE {PERIOD}),
    models AS (
      SELECT coalesce(model, '未知车型') AS model, CAST(sum(sales_volume) AS BIGINT) AS volume,
             CAST(sum(inventory) AS BIGINT) AS inventory,
             floor(sum(market_trend) / count(*) * 10 + 0.5) / 10 AS trend FROM period GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY volume DESC, model) AS rank FROM models),
    total AS (
      SELECT count(*) AS n_rows, count(DISTINCT coalesce(model, '未知车型')) AS n_models,
             CAST(sum(sales_volume) AS BIGINT) AS volume, CAST(sum(inventory) AS BIGINT) AS inventory,
             string_agg(DISTINCT region, '、' ORDER BY region) AS regions,
             string_agg(DISTINCT customer_type, '、' ORDER BY customer_type) AS kinds FROM period)
    {extra}
    SELECT CAST(1 AS BIGINT) AS line_no, '查询区间：1996-03，明细记录 ' || CAST(n_rows AS VARCHAR) || ' 条，覆盖 '
           || CAST(n_models AS VARCHAR) || ' 个车型' AS line FROM total
    UNION ALL SELECT 2, '覆盖区域：' || regions FROM total
    UNION ALL SELECT 3, '客户类型：' || kinds FROM total
    UNION ALL SELECT 4, '' UNION ALL SELECT 5, '车型维度汇总（按销量降序）：'
    UNION ALL SELECT rank + 5, CAST(rank AS VARCHAR) || '. ' || model || ' | 销量 ' || CAST(volume AS VARCHAR)
              || ' | 库存 ' || CAST(inventory AS VARCHAR) || ' | 平均市场趋势 ' || CAST(trend AS VARCHAR) || '%' FROM ranked
    UNION ALL SELECT n_models + 6, '' FROM total
    UNION ALL SELECT n_models + 7, '合计销量 ' || CAST(volume AS VARCHAR) || ' 辆，合计库存 '
              || CAST(inventory AS VARCHAR) || ' 辆。' FROM total"""


@query("f21_summary_lines", _summary_sql())
def f21_summary_lines(spark, sf_dir):
    return sales_report.summary_lines(car_sales(spark, sf_dir), "1996-03")


@query(
    "f21_answer_lines",
    _summary_sql()
    + " UNION ALL SELECT 0, '【本地兜底】大模型服务当前不可用，以下是直接查库得到的结果：' || chr(10)",
)
def f21_answer_lines(spark, sf_dir):
    return sales_report.answer(car_sales(spark, sf_dir), "查一下 1996-03 的销量")


@query(
    "f21_plan_texts",
    f"""WITH {PLAN}, texts AS (
      SELECT coalesce(model, 'null') AS model, CAST(CAST(market_trend AS FLOAT) AS VARCHAR) AS trend,
             coalesce(customer_type, 'null') AS kind, region, CAST(sales_volume AS VARCHAR) AS volume,
             CAST(target_sales AS VARCHAR) AS target, CAST(additional_sales AS VARCHAR) AS extra,
             CAST(inventory AS VARCHAR) AS stock, CAST(suggested_inventory AS VARCHAR) AS wanted,
             marketing_action AS action, promotion_method AS method, sales_channel AS channel,
             CAST(marketing_cost_plan AS VARCHAR) AS marketing, CAST(discount_cost_plan AS VARCHAR) AS discount,
             CAST(total_cost_plan AS VARCHAR) AS total
      FROM plan WHERE {PERIOD})
    SELECT concat_ws(chr(10), '车型：' || model, '1. 销售目标', '   - 当前销量：' || volume || ' 辆',
      '   - 市场趋势：' || trend || '% 的增长',
      '   - 目标销量：在未来 3 个月内将 ' || model || ' 销量提升至 ' || target || ' 辆，新增 ' || extra || ' 辆。',
      '2. 销售策略', '   - 客户定位：针对 ' || kind || '，推出 ' || action || '。',
      '   - 区域推广：在 ' || region || ' 投放 ' || method || '，吸引潜在客户。',
      '   - 库存管理：当前库存 ' || stock || ' 辆，建议补充至 ' || wanted || ' 辆，确保供应充足。',
      '   - 渠道优化：通过 ' || channel || ' 提升 ' || model || ' 的曝光率。', '3. 预算估算',
      '   - 营销费用：预计 ' || marketing || ' 元（基于新增销量，每辆车分配 50 元广告费用）。',
      '   - 折扣成本：预计 ' || discount || ' 元（基于折扣政策，每辆车补贴 20 元）。',
      '   - 总预算：' || total || ' 元。', '4. 执行时间表',
      '   - 第 1 个月：启动 ' || action || ' 和 ' || method || '，完成库存调整。',
      '   - 第 2-3 个月：跟踪销售进展，优化推广策略，预期实现 ' || extra || ' 辆新增销量。', '') AS plan_text
    FROM texts""",
)
def f21_plan_texts(spark, sf_dir):
    return sales_report.plan_texts(car_sales(spark, sf_dir), "1996-03").select("plan_text")
