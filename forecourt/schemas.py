"""Declared schemas of the platform's tables and files.

Counters are LONG where the source system used 32-bit ints, so totals cannot wrap.
Column names are fixed values: they are the headers of the exchanged files.
"""

from __future__ import annotations

CAR_SALES = (
    "sale_date DATE, model STRING, sales_volume INT, customer_type STRING, region STRING, "
    "market_trend DOUBLE, inventory INT, revenue DOUBLE, profit_margin DOUBLE, "
    "marketing_cost DOUBLE"
)
BRAND_RANKING = "id LONG, brand_name STRING, sales LONG"
BASIC_INFO = (
    "id LONG, onlineUsers INT, onlineMerchants INT, transactionAmount DOUBLE, "
    "transactionCount INT, totalParcels INT, shippedParcels INT"
)
MONTHLY_STATISTICS = "id LONG, month STRING, orderCount INT, paymentCount INT"
PARCEL_RANK = "id LONG, province STRING, parcelCount INT"
PLATFORM_PROPORTION = "id LONG, platform STRING, percentage DOUBLE"
CHAT_MESSAGE = (
    "id LONG, session_id STRING, role STRING, content STRING, tool_calls STRING, "
    "tool_call_id STRING, create_time TIMESTAMP"
)
TELEMETRY = (
    "ID STRING, Brand STRING, Model STRING, Year INT, Horsepower INT, Torque INT, "
    "FuelType STRING, `Length(mm)` INT, `Width(mm)` INT, `Height(mm)` INT"
)
USER_PROFILE = (
    "`姓名` STRING, `年龄` INT, `性别` STRING, `职业` STRING, `收入水平` STRING, "
    "`家庭结构` STRING, `城市` STRING, `用户类型` STRING, `电话号码` STRING, `邮箱` STRING"
)
WORD_FREQUENCY = "`字段` STRING, `词` STRING, `频率` LONG"
