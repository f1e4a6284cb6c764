"""Scalar functions as columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import names, numbers, text
from forecourt.suite import query
from forecourt.suite.views import table


@query(
    "f1_split_join",
    """SELECT event_id, event_type AS second, NULL::VARCHAR AS ninth,
              concat_ws(',', user_id, event_type, event_id) AS joined FROM events""",
)
def f1_split_join(spark, sf_dir):
    line = F.concat_ws(",", "event_id", "event_type", "user_id")
    events = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    field = [text.field_at(F.col("value"), i) for i in (1, 2, 3, 9)]
    return events.select(
        "event_id",
        field[1].alias("second"),
        field[3].alias("ninth"),
        F.concat_ws(",", field[2], field[1], field[0]).alias("joined"),
    )


@query(
    "f6_human_size",
    """SELECT o_orderkey, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B'
            WHEN size < 1048576 THEN CAST(floor(size / 1024.0::DOUBLE * 10 + 0.5) / 10 AS VARCHAR) || ' KB'
            ELSE CAST(floor(size / 1048576.0::DOUBLE * 10 + 0.5) / 10 AS VARCHAR) || ' MB' END AS size_text
       FROM (SELECT o_orderkey, o_custkey * (1 + o_orderkey % 5 * 300) AS size FROM orders) o""",
)
def f6_human_size(spark, sf_dir):
    size = F.col("o_custkey") * (1 + F.col("o_orderkey") % 5 * 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.human_size(size).alias("size_text"))


@query(
    "f7_round_half_up",
    "SELECT event_id, floor((value - 50) * 10 + 0.5) / 10 AS rounded FROM events",
)
def f7_round_half_up(spark, sf_dir):
    rounded = numbers.round_half_up_1(F.col("value") - 50).alias("rounded")
    return table(spark, sf_dir, "events").select("event_id", rounded)


@query("f8_money", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS amount FROM orders")
def f8_money(spark, sf_dir):
    amount = numbers.fixed_2(F.col("o_totalprice")).alias("amount")
    return table(spark, sf_dir, "orders").select("o_orderkey", amount)


ADDRESS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'h' || CAST(page_id AS VARCHAR) || ':99'
    WHEN 2 THEN 'tcp://h' || CAST(page_id AS VARCHAR) || ':80x/a:1' WHEN 3 THEN ''
    WHEN 4 THEN ' ws://a:b:' || CAST(page_id AS VARCHAR) || '/x ' ELSE ':7' END AS address FROM pages"""


def _addresses(spark, sf_dir):
    page, number = F.col("page_id"), F.col("page_id").cast("string")
    address = (
        F.when(page % 6 == 0, F.col("url"))
        .when(page % 6 == 1, F.concat(F.lit("h"), number, F.lit(":99")))
        .when(page % 6 == 2, F.concat(F.lit("tcp://h"), number, F.lit(":80x/a:1")))
        .when(page % 6 == 3, "")
        .when(page % 6 == 4, F.concat(F.lit(" ws://a:b:"), number, F.lit("/x ")))
        .otherwise(":7")
    )
    return table(spark, sf_dir, "pages").select("page_id", address.alias("address"))


@query(
    "f10_host_port",
    f"""WITH a AS (SELECT page_id, split_part(regexp_replace(trim(address), '^.*?://', ''), '/', 1) AS s FROM ({ADDRESS}) x),
        b AS (SELECT page_id, s, length(s) - instr(reverse(s), ':') + 1 AS colon, instr(s, ':') AS has FROM a)
        SELECT page_id, CASE WHEN s = '' THEN '127.0.0.1' WHEN has > 0 AND colon > 1 THEN left(s, colon - 1) ELSE s END AS host,
               CASE WHEN has > 0 AND colon > 1 THEN coalesce(TRY_CAST(substr(s, colon + 1) AS INT), 9999)
                    ELSE 9999 END AS port FROM b""",
)
def f10_host_port(spark, sf_dir):
    address = F.col("address")
    return _addresses(spark, sf_dir).select(
        "page_id", names.host(address).alias("host"), names.port(address).alias("port")
    )


@query(
    "f11_socket_host",
    """SELECT page_id, split_part(split_part(url, '://', 2), ':', 1)
              || CASE WHEN page_id % 3 = 0 THEN '/p' ELSE '' END AS host FROM pages""",
)
def f11_socket_host(spark, sf_dir):
    rest = F.regexp_replace("url", "^https?://", "")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("wss://"), rest, F.lit("/p"))).otherwise(
        F.concat(F.lit("ws://"), rest, F.lit(":8080/p"))
    )
    return table(spark, sf_dir, "pages").select("page_id", names.socket_host(url).alias("host"))


@query(
    "f13_f14_stamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""",
)
def f13_f14_stamps(spark, sf_dir):
    moment = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", names.iso_utc(moment).alias("iso"), names.file_stamp(moment).alias("stamp")
    )


@query(
    "f16_f17_f22_text",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '无可分析的文本' ELSE text END AS shown,
              CASE WHEN doc_id % 14 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '  ' || chr(10)
                   WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS brief,
              doc_id % 7 = 0 AS blank
       FROM documents""",
)
def f16_f17_f22_text(spark, sf_dir):
    doc = F.col("doc_id")
    value = F.when(doc % 14 == 0, F.lit(None).cast("string")).when(doc % 7 == 0, "  \n").otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))
    value = F.col("value")
    return docs.select(
        "doc_id",
        text.blank_default(value).alias("shown"),
        text.short_text(value).alias("brief"),
        text.is_blank(value).alias("blank"),
    )


@query(
    "f18_json_arguments",
    """SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
              CASE WHEN event_id % 5 IN (1, 2, 3) THEN 0 ELSE 1 END AS n_arguments FROM events""",
)
def f18_json_arguments(spark, sf_dir):
    event, props = F.col("event_id"), F.col("props")
    arguments = (
        F.when(event % 5 == 1, F.expr("left(props, length(props) - 1)"))
        .when(event % 5 == 2, F.concat(F.lit("["), props, F.lit("]")))
        .when(event % 5 == 3, F.lit(" "))
        .otherwise(props)
    )
    parsed = table(spark, sf_dir, "events").select("event_id", text.json_arguments(arguments).alias("m"))
    return parsed.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n_arguments"))


@query(
    "f20_decoded_names",
    """SELECT p_partkey, '销 ' || p_name || '.csv' AS name FROM part""",
)
def f20_decoded_names(spark, sf_dir):
    encoded = F.concat(
        F.lit("%E9%94%80+"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.lit("%2Ecsv")
    )
    return table(spark, sf_dir, "part").select("p_partkey", names.decoded_name(encoded).alias("name"))


@query(
    "f22_number_coercion",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id ELSE 0 END AS whole,
              CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN value ELSE 0 END::DOUBLE AS number FROM events""",
)
def f22_number_coercion(spark, sf_dir):
    event = F.col("event_id")
    shown = (
        F.when(event % 4 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
        .when(event % 4 == 1, F.concat(F.col("value").cast("string"), F.when(F.col("value") % 1 == 0, "0").otherwise("")))
        .when(event % 4 == 2, F.col("event_type"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", shown.alias("shown"))
    return rows.select(
        "event_id",
        numbers.int_or_zero(F.col("shown")).alias("whole"),
        numbers.double_or_zero(F.col("shown")).alias("number"),
    )
