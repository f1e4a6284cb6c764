"""Sales queries, summaries and plans over the ``car_sales`` facts."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.numbers import double_or_zero, int_or_zero, round_half_up_1
from forecourt.operators.ranking import number_rows

# Names, messages and rates of the platform's sales rules.
UNKNOWN_MODEL = "未知车型"
NOTHING = "无"
LIST_SEPARATOR = "、"
ACTIONS = {
    "中小企业": "批量采购享 5% 折扣",
    "个人": "首购客户享 10% 折扣",
    "大企业": "企业客户赠送一年保养服务",
    "政府": "政府采购提供定制化服务",
}
DEFAULT_ACTION = "常规促销活动"
ONLINE_REGIONS = ["北京", "上海", "广州", "深圳"]
OFFLINE_REGIONS = ["成都", "南京", "杭州"]
ONLINE_METHOD = "线上广告"
OFFLINE_METHOD = "线下车展"
LOCAL_METHOD = "本地经销商活动"
DEALER_CHANNEL = "4S店"
WEB_CHANNEL = "电商平台"
CHANNEL_THRESHOLD = 300
SAFETY_RATE = 0.1
MONTH_COLUMN = "sale_month"
MARKETING_PER_UNIT = 50
DISCOUNT_PER_UNIT = 20


def date_bounds(text: str) -> tuple[datetime.date, datetime.date]:
    """Half-open day range of ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``."""
    if text is None or not text.strip():
        raise ValueError("the sales date must not be empty")
    found = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", text.strip(), flags=re.ASCII)
    if not found:
        raise ValueError("sales dates look like yyyy, yyyy-MM or yyyy-MM-dd")
    year, month, day = (int(g) if g else None for g in found.groups())
    start = datetime.date(year, month or 1, day or 1)
    if day:
        return start, start + datetime.timedelta(days=1)
    if month:
        return start, datetime.date(year + month // 12, month % 12 + 1, 1)
    return start, datetime.date(year + 1, 1, 1)


def in_period(df: DataFrame, period: str, column: str = "sale_date") -> DataFrame:
    """Rows of a day, month or year; the range reaches the scan.

    Facts stored by month (``sinks.tables.write_by_month``) are also pruned to those folders.
    """
    start, end = date_bounds(period)
    rows = df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))
    if MONTH_COLUMN in df.columns:
        last = end - datetime.timedelta(days=1)
        rows = rows.filter(F.col(MONTH_COLUMN).between(f"{start:%Y-%m}", f"{last:%Y-%m}"))
    return rows


def sales_of(df: DataFrame, period: str) -> DataFrame:
    """Sales rows of a period ordered by model, NULL models first.

    The further columns let the range sort split a model that holds very many rows.
    """
    within = [c for c in ("sale_date", "revenue", "sales_volume", "region") if c in df.columns]
    return in_period(df, period).orderBy(F.col("model").asc_nulls_first(), *within)


def model_or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNKNOWN_MODEL))


def by_model(df: DataFrame) -> DataFrame:
    """Volume, inventory, rows and mean trend per model; NULL measures count as 0."""
    return df.groupBy(model_or_unknown(F.col("model")).alias("model")).agg(
        F.sum(int_or_zero(F.col("sales_volume"))).alias("volume"),
        F.sum(int_or_zero(F.col("inventory"))).alias("inventory"),
        F.count("*").alias("n_rows"),
        round_half_up_1(F.avg(double_or_zero(F.col("market_trend")))).alias("avg_trend"),
    )


def ranked_models(df: DataFrame) -> DataFrame:
    """Models by volume, ties by name, with 1-based ranks."""
    return number_rows(by_model(df), [F.col("volume").desc(), F.col("model")], "rank")


def totals(df: DataFrame) -> DataFrame:
    """Grand totals, from the per-model sums (no second pass, no distinct shuffle)."""
    return by_model(df).agg(
        F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
        F.coalesce(F.sum("inventory"), F.lit(0)).alias("total_inventory"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_models"),
    )


def joined_list(column: str) -> Column:
    """Distinct values of a group in one sorted text."""
    values = F.array_sort(F.collect_set(column))
    return F.when(F.size(values) == 0, F.lit(NOTHING)).otherwise(F.array_join(values, LIST_SEPARATOR))


def coverage_rows(df: DataFrame) -> DataFrame:
    """Distinct regions and customer types as rows ``(kind, value)``, for lists of any length."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("region", "customer_type")]
    return df.select(F.inline(F.array(*kinds))).filter(F.col("value").isNotNull()).distinct()


def coverage(df: DataFrame) -> DataFrame:
    """Distinct regions and customer types as two joined, sorted lists.

    Each list is one value, as long as the names together; ``coverage_rows`` has no such value.
    """
    # Distinct pairs first, so that the sets are filled from few rows.
    pairs = df.select("region", "customer_type").distinct()
    return pairs.agg(
        joined_list("region").alias("regions"), joined_list("customer_type").alias("customer_types")
    )


def marketing_action(c: Column) -> Column:
    chosen = F.lit(DEFAULT_ACTION)
    for kind, action in ACTIONS.items():
        chosen = F.when(c == kind, F.lit(action)).otherwise(chosen)
    return chosen


def promotion_method(c: Column) -> Column:
    return (
        F.when(c.isin(ONLINE_REGIONS), F.lit(ONLINE_METHOD))
        .when(c.isin(OFFLINE_REGIONS), F.lit(OFFLINE_METHOD))
        .otherwise(F.lit(LOCAL_METHOD))
    )


def sales_channel(volume: Column) -> Column:
    return F.when(volume > CHANNEL_THRESHOLD, F.lit(DEALER_CHANNEL)).otherwise(F.lit(WEB_CHANNEL))


def target_sales(volume: Column, trend: Column) -> Column:
    """Volume grown by the trend in percent, cut to a whole number.

    The arithmetic is 32-bit float at every step, which decides some last units
    (50 at 6.0 % gives 52).
    """
    def as_float(c: Column) -> Column:
        return c.cast("float")

    factor = as_float(F.lit(1).cast("float") + as_float(as_float(trend) / F.lit(100).cast("float")))
    grown = as_float(as_float(volume) * factor)
    return F.coalesce(grown.try_cast("bigint"), F.lit(0).cast("bigint"))  # NaN gives 0


def sales_plan(df: DataFrame) -> DataFrame:
    """Targets, stock, costs, actions and channel of every sales row."""
    volume, additional = F.col("sales_volume"), F.col("additional_sales")
    return (
        df.withColumns(
            {
                "sales_volume": int_or_zero(volume),
                "inventory": int_or_zero(F.col("inventory")),
                "market_trend": double_or_zero(F.col("market_trend")),
            }
        )
        .withColumns(
            {
                "target_sales": target_sales(volume, F.col("market_trend")),
                "additional_sales": target_sales(volume, F.col("market_trend")) - volume,
                "safety_stock": (volume * F.lit(SAFETY_RATE)).cast("bigint"),
                "marketing_action": marketing_action(F.col("customer_type")),
                "promotion_method": promotion_method(F.col("region")),
                "sales_channel": sales_channel(volume),
            }
        )
        .withColumns(
            {
                "suggested_inventory": F.col("inventory") + additional + F.col("safety_stock"),
                "marketing_cost_plan": additional * MARKETING_PER_UNIT,
                "discount_cost_plan": additional * DISCOUNT_PER_UNIT,
                "total_cost_plan": additional * MARKETING_PER_UNIT + additional * DISCOUNT_PER_UNIT,
            }
        )
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.coalesce(F.sum("target_sales"), F.lit(0)).alias("total_target_sales"),
        F.coalesce(F.sum("total_cost_plan"), F.lit(0)).alias("total_budget"),
    )
