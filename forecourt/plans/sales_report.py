"""Text reports: sales summaries, sales plans, answers to questions with a date."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.numbers import double_or_zero, int_or_zero, round_half_up_1
from forecourt.functions.text import DATE_PATTERNS
from forecourt.operators import sales
from forecourt.operators.ranking import number_rows
from forecourt.workspace import stored

# Wording of the reports.
NOT_FOUND = "未找到 %s 的销售数据"
SUMMARY_RANGE = "查询区间：%s，明细记录 %s 条，覆盖 %s 个车型"
SUMMARY_REGIONS = "覆盖区域：%s"
SUMMARY_CUSTOMERS = "客户类型：%s"
SUMMARY_TABLE = "车型维度汇总（按销量降序）："
SUMMARY_MODEL = "%s. %s | 销量 %s | 库存 %s | 平均市场趋势 %s%%"
SUMMARY_TOTAL = "合计销量 %s 辆，合计库存 %s 辆。"
PLAN_TITLE = "销售方案 - %s\n针对所有车型的综合销售计划如下：\n"
PLAN_MODEL = (
    "车型：{model}\n"
    "1. 销售目标\n"
    "   - 当前销量：{volume} 辆\n"
    "   - 市场趋势：{trend}% 的增长\n"
    "   - 目标销量：在未来 3 个月内将 {model} 销量提升至 {target} 辆，新增 {additional} 辆。\n"
    "2. 销售策略\n"
    "   - 客户定位：针对 {customer}，推出 {action}。\n"
    "   - 区域推广：在 {region} 投放 {method}，吸引潜在客户。\n"
    "   - 库存管理：当前库存 {inventory} 辆，建议补充至 {suggested} 辆，确保供应充足。\n"
    "   - 渠道优化：通过 {channel} 提升 {model} 的曝光率。\n"
    "3. 预算估算\n"
    "   - 营销费用：预计 {marketing} 元（基于新增销量，每辆车分配 50 元广告费用）。\n"
    "   - 折扣成本：预计 {discount} 元（基于折扣政策，每辆车补贴 20 元）。\n"
    "   - 总预算：{total} 元。\n"
    "4. 执行时间表\n"
    "   - 第 1 个月：启动 {action} 和 {method}，完成库存调整。\n"
    "   - 第 2-3 个月：跟踪销售进展，优化推广策略，预期实现 {additional} 辆新增销量。\n"
)
PLAN_CLOSING = "总结：\n- 总目标销量：%s 辆\n- 总预算：%s 元\n- 执行周期：3 个月\n"
NO_DATE = (
    "【本地兜底】大模型服务当前不可用，且没能从你的问题里识别出时间范围。\n"
    "请稍后重试，或把问题写得更具体，例如「查一下 2025-03 的销量」。"
)
FALLBACK_TITLE = "【本地兜底】大模型服务当前不可用，以下是直接查库得到的结果：\n"


def _text(c: Column | str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(column.cast("string"), F.lit("null"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{name}`` places filled from columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def summary_lines(facts: DataFrame, period: str) -> DataFrame:
    """The summary of a period as rows ``(line_no, line)``.

    One scan reduces the facts to (model, region, customer type) cells; everything else is
    computed from those.  Without sales in the period there is one line saying so.
    """
    cells = stored(
        sales.in_period(facts, period)
        .groupBy(sales.model_or_unknown(F.col("model")).alias("model"), "region", "customer_type")
        .agg(
            F.sum(int_or_zero(F.col("sales_volume"))).alias("volume"),
            F.sum(int_or_zero(F.col("inventory"))).alias("inventory"),
            F.sum(double_or_zero(F.col("market_trend"))).alias("trend"),
            F.count("*").alias("n_rows"),
        ),
        "cells",
    )
    models = cells.groupBy("model").agg(
        F.sum("volume").alias("volume"),
        F.sum("inventory").alias("inventory"),
        round_half_up_1(F.sum("trend") / F.sum("n_rows")).alias("avg_trend"),
    )
    ranked = number_rows(models, [F.col("volume").desc(), F.col("model")], "rank")
    model_lines = ranked.select(
        (F.col("rank") + 5).cast("bigint").alias("line_no"),
        F.format_string(SUMMARY_MODEL, "rank", "model", "volume", "inventory", "avg_trend").alias("line"),
    )
    total = cells.agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("volume").alias("volume"),
        F.sum("inventory").alias("inventory"),
        F.count_distinct("model").alias("n_models"),
        sales.joined_list("region").alias("regions"),
        sales.joined_list("customer_type").alias("customer_types"),
    )
    found = F.col("n_rows").isNotNull()
    numbered = F.array(
        _line(1, F.format_string(SUMMARY_RANGE, F.lit(period), "n_rows", "n_models")),
        _line(2, F.format_string(SUMMARY_REGIONS, "regions")),
        _line(3, F.format_string(SUMMARY_CUSTOMERS, "customer_types")),
        _line(4, F.lit("")),
        _line(5, F.lit(SUMMARY_TABLE)),
        _line(F.col("n_models") + 6, F.lit("")),
        _line(F.col("n_models") + 7, F.format_string(SUMMARY_TOTAL, "volume", "inventory")),
    )
    nothing = F.array(_line(1, F.lit(NOT_FOUND.replace("%s", period))))
    frame = total.select(F.inline(F.when(found, numbered).otherwise(nothing)))
    return frame.unionByName(model_lines)


def _line(number: Column | int, text: Column) -> Column:
    n = F.lit(number) if isinstance(number, int) else number
    return F.struct(n.cast("bigint").alias("line_no"), text.alias("line"))


def plan_texts(facts: DataFrame, period: str) -> DataFrame:
    """The plan of a period: its rows with target, cost and the text of each row."""
    plan = sales.sales_plan(sales.in_period(facts, period))
    values = {
        "model": _text("model"),
        "volume": _text("sales_volume"),
        "trend": _text(F.col("market_trend").cast("float")),
        "target": _text("target_sales"),
        "additional": _text("additional_sales"),
        "customer": _text("customer_type"),
        "action": _text("marketing_action"),
        "region": _text("region"),
        "method": _text("promotion_method"),
        "inventory": _text("inventory"),
        "suggested": _text("suggested_inventory"),
        "channel": _text("sales_channel"),
        "marketing": _text("marketing_cost_plan"),
        "discount": _text("discount_cost_plan"),
        "total": _text("total_cost_plan"),
    }
    return plan.withColumn("plan_text", _filled(PLAN_MODEL, values))


def plan_lines(facts: DataFrame, period: str) -> DataFrame:
    """The whole plan as rows ``(part, model, text)``: title 0, one text per row 1, closing 2."""
    plan = plan_texts(facts, period)
    closing = plan.agg(
        F.format_string(PLAN_CLOSING, F.sum("target_sales"), F.sum("total_cost_plan")).alias("closing"),
        F.count("*").alias("n"),
    )
    frame = closing.select(
        F.inline(
            F.when(
                F.col("n") > 0,
                F.array(_part(0, F.lit(PLAN_TITLE.replace("%s", period))), _part(2, F.col("closing"))),
            ).otherwise(F.array(_part(0, F.lit(NOT_FOUND.replace("%s", period)))))
        )
    )
    rows = plan.select(F.lit(1).alias("part"), "model", F.col("plan_text").alias("text"))
    return frame.unionByName(rows)


def _part(number: int, text: Column) -> Column:
    return F.struct(
        F.lit(number).alias("part"), F.lit(None).cast("string").alias("model"), text.alias("text")
    )


def period_in(question: str | None) -> str | None:
    """The most precise date in a question, as text."""
    for pattern in DATE_PATTERNS:
        found = re.search(pattern, question or "", flags=re.ASCII)
        if found:
            return found.group(0)
    return None


def answer(facts: DataFrame, question: str) -> DataFrame:
    """Summary lines for the period named in a question, under a heading (line 0)."""
    spark = facts.sparkSession
    period = period_in(question)
    if period is None:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit(NO_DATE).alias("line"))
    heading = spark.range(1).select(
        F.lit(0).cast("bigint").alias("line_no"), F.lit(FALLBACK_TITLE).alias("line")
    )
    return heading.unionByName(summary_lines(facts, period))
