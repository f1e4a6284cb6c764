"""Operators on small frames: quirks, properties, brute force."""

import datetime
import random

import pytest
from conftest import values
from pyspark.sql import Window, functions as F

from forecourt.operators import conversations, dedup, documents, filelists, geo, ranking, sales, stats, words
from forecourt.plans import sales_report


def test_word_frequency(spark):
    df = spark.createDataFrame([("  a b ", 1), (None, 1), ("a", 22)], "t STRING, n INT")
    got = values(words.word_frequency(df, {"t": F.col("t"), "n": F.col("n")}))
    assert got == [("n", "1", 2), ("n", "22", 1), ("t", "", 2), ("t", "a", 2), ("t", "b", 1)]


def test_counts_add_up_to_the_tokens(spark):
    lines = spark.createDataFrame([("a b  c",), ("",), ("  a ",)], "value STRING")
    assert words.token_count(lines).agg(F.sum("freq")).first()[0] == 4
    twice = words.token_count(lines.unionByName(lines))
    assert values(twice) == [(w, 2 * n) for w, n in values(words.token_count(lines))]


def test_limit_comes_before_the_blank_filter(spark):
    rows = [(" ",)] * 9 + [("a",)] * 5 + [("b",)] * 4
    top = stats.top_counts(spark.createDataFrame(rows, "k STRING"), "k", 2)
    assert values(stats.drop_blank_names(top)) == [("a", 5)]


def test_keys_that_differ_by_spaces_stay_apart(spark):
    df = spark.createDataFrame([("a ",), ("a",), ("a",), (None,)], "k STRING")
    top = stats.top_counts(df, "k", 10)
    assert values(top) == [(None, 1), ("a", 2), ("a ", 1)]
    assert values(stats.drop_blank_names(top)) == [("a", 1), ("a", 2)]


def test_top_n_and_column_rules(spark):
    assert [stats.effective_top_n(n) for n in (0, -1, None, 3)] == [10, 10, 10, 3]
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert stats.count_column(df, "a") == ("a", False)
    assert stats.count_column(df, "z") == ("b", True)
    assert stats.count_column(df, "  ") == ("b", True)
    assert stats.count_column(df.select("a"), None) == ("a", True)


def test_top_counts_with_total_counts_every_row(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"))
    rows = stats.top_counts_with_total(df, "k", 2).collect()
    assert [tuple(r) for r in rows] == [(0, 15, 100), (1, 15, 100)]


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "n STRING, v INT")
    assert values(stats.share_of_total(df, "v"), "n", "share") == [("a", 33.33), ("b", 66.67)]


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_number_rows_over_many_partitions(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(rows).select("id", (F.col("id") % 3).alias("k"))
        got = ranking.number_rows(df, [F.col("k").desc(), F.col("id")], "n").cache()
        order = Window.orderBy(F.col("k").desc(), F.col("id"))
        expected = df.withColumn("n", F.row_number().over(order).cast("bigint"))
        assert values(got.select("id", "n")) == values(expected.select("id", "n"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rank_labels(spark):
    df = spark.range(12).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (100 - F.col("id")).alias("v"))
    labels = [r[0] for r in ranking.rank_labels(df, "v", "name").orderBy(F.col("v").desc()).select("rank_label").collect()]
    assert labels[0] == "00p0" and labels[9] == "09p9" and labels[10:] == ["10p10", "11p11"]


def test_numbered_top(spark):
    df = spark.range(50)
    got = ranking.numbered_top(df, [F.col("id").desc()], 3, "rank")
    assert values(got) == [(47, 3), (48, 2), (49, 1)]


def test_dedup_keeps_the_key_set_and_is_idempotent(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.choice("ab"), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k INT, c STRING, i INT")
    once = dedup.dedup_columns(df, "k,c", [F.col("i")])
    assert values(once.select("k", "c")) == values(df.select("k", "c").distinct())
    assert values(dedup.dedup_columns(once, "k,c", [F.col("i")])) == values(once)
    firsts = {}
    for k, c, i in rows:
        firsts.setdefault((k, c), i)
    assert values(once) == sorted((k, c, i) for (k, c), i in firsts.items())


def test_dedup_without_other_columns_or_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k INT, c STRING")
    assert values(dedup.dedup_columns(df, "k,c")) == [(1, "a"), (1, "b")]
    assert values(dedup.dedup_columns(df, "k")) == [(1, "a")]
    assert values(dedup.dedup_columns(df, dedup.ALL_FIELDS)) == [(1, "a"), (1, "b")]


def test_dedup_lines(spark):
    df = spark.createDataFrame([("b,1",), ("a,1",), ("c",), ("c",), ("d,",)], "value STRING")
    assert values(dedup.dedup_lines(df, "2")) == [("a,1",), ("c",), ("d,",)]
    assert values(dedup.dedup_lines(df, dedup.ALL_FIELDS)) == [("a,1",), ("b,1",), ("c",), ("d,",)]


SALES = "sale_date DATE, model STRING, sales_volume INT, customer_type STRING, region STRING, market_trend DOUBLE, inventory INT, revenue DOUBLE"


def sale(day, model, volume, kind, region, trend, stock):
    return (datetime.date.fromisoformat(day), model, volume, kind, region, trend, stock, 1.0)


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(
        [
            sale("2025-03-01", "A", 50, "个人", "北京", 6.0, 10),
            sale("2025-03-31", "B", 100, "政府", "成都", -2.0, 20),
            sale("2025-04-01", "A", 301, None, "X", None, 5),
            sale("2024-12-31", None, 300, "?", None, 0.0, 7),
        ],
        SALES,
    )


def test_periods(facts):
    assert sales.sales_of(facts, "2025-03").count() == 2
    assert sales.sales_of(facts, "2025").count() == 3
    assert sales.sales_of(facts, " 2024-12-31 ").count() == 1
    assert sales.date_bounds("2024-12")[1] == datetime.date(2025, 1, 1)
    assert sales.date_bounds("2024-02-29")[1] == datetime.date(2024, 3, 1)


@pytest.mark.parametrize("period", ["", None, "  ", "20%5", "2025-3", "2025-03-1", "2025-13", "2025-02-30", "20250301", "202_-03"])
def test_bad_periods_are_errors(facts, period):
    with pytest.raises(ValueError):
        sales.in_period(facts, period)


def test_sales_order_has_null_models_first(facts):
    moved = facts.withColumn("sale_date", F.lit(datetime.date(2025, 5, 1)))
    assert [r["model"] for r in sales.sales_of(moved, "2025").collect()] == [None, "A", "A", "B"]


def test_trend_that_is_no_number(spark):
    df = spark.createDataFrame([("A", 5, "NaN")], "model STRING, sales_volume INT, market_trend STRING")
    plan = sales.sales_plan(df.withColumns({c: F.lit(None).cast("string") for c in ("inventory", "customer_type", "region")}))
    assert plan.first()["target_sales"] == 0
    assert sales.by_model(df.withColumn("inventory", F.lit(0))).first()["avg_trend"] == 0.0


def test_plan_pins(facts):
    plan = {(r["model"], r["sales_volume"]): r for r in sales.sales_plan(facts).collect()}
    grown = plan["A", 50]
    assert (grown["target_sales"], grown["additional_sales"], grown["safety_stock"]) == (52, 2, 5)
    assert (grown["suggested_inventory"], grown["total_cost_plan"]) == (17, 140)
    shrunk = plan["B", 100]
    assert (shrunk["target_sales"], shrunk["additional_sales"]) == (98, -2)
    assert (shrunk["marketing_cost_plan"], shrunk["discount_cost_plan"]) == (-100, -40)
    assert plan["A", 301]["sales_channel"] == sales.DEALER_CHANNEL
    assert plan[None, 300]["sales_channel"] == sales.WEB_CHANNEL
    assert plan["A", 301]["marketing_action"] == sales.DEFAULT_ACTION
    assert plan[None, 300]["promotion_method"] == sales.LOCAL_METHOD


def test_target_is_float32(spark):
    import numpy as np

    rows = [(v, t / 10) for v in range(11, 551, 7) for t in range(-20, 151)]
    df = spark.createDataFrame(rows, "v INT, t DOUBLE")
    got = df.select("v", "t", sales.target_sales(F.col("v"), F.col("t")).alias("x")).collect()
    for v, t, x in got:
        factor = np.float32(1) + np.float32(t) / np.float32(100)
        assert x == int(np.float32(v) * factor), (v, t)


def test_by_model_and_totals(facts):
    assert values(sales.by_model(facts), "model", "volume", "inventory", "n_rows", "avg_trend") == [
        ("A", 351, 15, 2, 3.0), ("B", 100, 20, 1, -2.0), ("未知车型", 300, 7, 1, 0.0),
    ]
    assert values(sales.ranked_models(facts), "rank", "model") == [(1, "A"), (2, "未知车型"), (3, "B")]
    assert values(sales.totals(facts)) == [(751, 42, 4, 3)]
    assert values(sales.totals(facts.limit(0))) == [(0, 0, 0, 0)]
    assert values(sales.coverage(facts)) == [("X、北京、成都", "?、个人、政府")]
    nothing = facts.withColumns({c: F.lit(None).cast("string") for c in ("region", "customer_type")})
    assert values(sales.coverage(nothing)) == [("无", "无")]


def test_text_measures_are_coerced(spark):
    df = spark.createDataFrame([("A", " 5 ", "x", "1.5")], "model STRING, sales_volume STRING, inventory STRING, market_trend STRING")
    assert values(sales.by_model(df)) == [("A", 5, 0, 1, 1.5)]


def test_summary_and_answers(facts):
    lines = [r["line"] for r in sales_report.summary_lines(facts, "2025").orderBy("line_no").collect()]
    assert lines[0] == "查询区间：2025，明细记录 3 条，覆盖 2 个车型"
    assert lines[5] == "1. A | 销量 351 | 库存 15 | 平均市场趋势 3.0%"
    assert lines[-2:] == ["", "合计销量 451 辆，合计库存 35 辆。"]
    assert [r["line"] for r in sales_report.summary_lines(facts, "1999").collect()] == ["未找到 1999 的销售数据"]
    assert sales_report.answer(facts, "你好").first()["line"] == sales_report.NO_DATE
    answer = sales_report.answer(facts, "看看2025-03的销量").orderBy("line_no").collect()
    assert answer[1]["line"].startswith("查询区间：2025-03，明细记录 2 条")


def test_plan_lines(facts):
    rows = sales_report.plan_lines(facts, "2025-03").orderBy("part", "model").collect()
    assert [r["part"] for r in rows] == [0, 1, 1, 2]
    assert rows[0]["text"].startswith("销售方案 - 2025-03\n")
    assert "市场趋势：6.0% 的增长" in rows[1]["text"]
    assert rows[3]["text"].splitlines()[1] == "- 总目标销量：150 辆"
    assert [r["text"] for r in sales_report.plan_lines(facts, "1999").collect()] == ["未找到 1999 的销售数据"]


def test_slice_percentages_add_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "n STRING, v INT")
    got = values(stats.slice_percentages(df, "n", "v", [F.col("n")]), "n", "percent")
    assert got == [("a", 33.34), ("b", 33.33), ("c", 33.33)]
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "n INT, v INT")
    got = values(stats.slice_percentages(df, "n", "v", [F.col("n")]), "percent")
    assert round(sum(p for p, in got), 6) == 100 and len(got) == 300
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "n STRING, v INT")
    assert values(stats.slice_percentages(zero, "n", "v", [F.col("n")]), "percent") == [(0.0,), (0.0,)]


def test_replayed_messages(spark):
    df = messages(spark, [("tool", "", None), ("user", None, ""), ("assistant", "x", "[1]"), ("assistant", "y", "[1")])
    got = values(conversations.replayable(df), "id", "content", "tool_calls")
    assert got == [(1, "", None), (2, "x", "[1]"), (3, "y", None)]


def test_geo(spark):
    places = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name STRING, lon DOUBLE, lat DOUBLE")
    points = spark.createDataFrame([("a", 5), ("b", 9), ("c", 7)], "name STRING, value INT")
    assert values(geo.with_coordinates(points, places)) == [("a", [1.0, 2.0, 5.0]), ("b", [3.0, 4.0, 9.0])]
    assert values(geo.top_points(points, places, 2)) == [("b", [3.0, 4.0, 9.0])]
    assert values(geo.flow_lines(points, places, "b")) == [(3.0, 4.0, "a", 1.0, 2.0, 5), (3.0, 4.0, "b", 3.0, 4.0, 9)]
    assert values(geo.flow_lines(points, places, "nowhere")) == []
    measures = spark.createDataFrame([("a", "d1", 1.0), ("c", "d1", 2.0)], "name STRING, measure STRING, value DOUBLE")
    assert values(geo.align_measures(places, measures, ["d1", "d2"])) == [("a", 1.0, None), ("b", None, None)]


def test_bars(spark):
    wide = spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 9.0), ("c", None, 2.0)], "name STRING, x DOUBLE, y DOUBLE")
    slides = geo.slide_rows(wide, [("x", "x"), ("x", "y")])
    assert values(geo.bar_arrays(slides)) == [
        (0, ["c", "b", "a"], [None, 1.0, 3.0]), (1, ["c", "b", "a"], [2.0, 9.0, 1.0]),
    ]
    assert values(geo.bar_rows(slides), "slide", "place", "name") == [
        (0, 1, "c"), (0, 2, "b"), (0, 3, "a"), (1, 1, "c"), (1, 2, "b"), (1, 3, "a"),
    ]


def test_name_resolution(spark):
    files = ["a", "b.pdf", "b.csv", "c.zip", "c.aaa", "d.e.txt", "d.csv", "x.tar.gz"]
    catalog = spark.createDataFrame([(f, f) for f in files], "name STRING, path STRING")
    asked = ["a", "b", "b.pdf", "c", "d", "d.e", "x", "x.tar", "q"]
    wanted = spark.createDataFrame([(w,) for w in asked], "wanted STRING")
    got = dict(values(filelists.resolve_names(wanted, catalog)))
    assert got == {
        "a": "a", "b": "b.csv", "b.pdf": "b.pdf", "c": "c.aaa", "d": "d.csv", "d.e": "d.e.txt",
        "x": "x.tar.gz", "x.tar": "x.tar.gz", "q": None,
    }
    downloads = dict(values(filelists.resolve_names(wanted, catalog, ["csv", "pdf"])))
    assert downloads["b"] == "b.csv" and downloads["c"] is None and downloads["a"] == "a"


def test_catalog_counts(spark):
    start = datetime.datetime(2025, 1, 2)
    moments = [start - datetime.timedelta(seconds=1), start, start + datetime.timedelta(hours=23), start + datetime.timedelta(days=1)]
    df = spark.createDataFrame([(f"f{i}", m, i) for i, m in enumerate(moments)], "name STRING, modify_time TIMESTAMP_NTZ, size LONG")
    assert values(filelists.modified_on(df, F.lit("2025-01-02"))) == [(4, 2)]
    viewed = spark.createDataFrame([("f0",), ("f0",), ("zz",)], "name STRING")
    assert values(filelists.pending(df, viewed)) == [(3,)]
    many = spark.range(35).select(F.format_string("f%02d", "id").alias("name"), F.lit("p").alias("path"), F.lit(10).alias("size"))
    listed = filelists.listing(many)
    assert listed.count() == 30 and listed.first()["left_out"] == 5
    assert filelists.listing(many.limit(3)).first()["left_out"] == 0
    with pytest.raises(ValueError):
        filelists.sorted_by(many, "owner")


def messages(spark, rows):
    return spark.createDataFrame(
        [("s", i, role, text, calls) for i, (role, text, calls) in enumerate(rows)],
        "session_id STRING, id LONG, role STRING, content STRING, tool_calls STRING",
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_display(spark):
    df = messages(spark, [("system", "x", None), ("user", "hi", None), ("assistant", "", None),
                          ("assistant", "t", "[1]"), ("assistant", "t", ""), ("tool", "r", None), ("user", None, None)])
    assert ids(conversations.displayable(df)) == [1, 4]


def test_orphan_head(spark):
    df = messages(spark, [("tool", "", None), ("assistant", "", "[1]"), ("user", "", None), ("tool", "", None)])
    assert ids(conversations.without_orphan_head(df)) == [2, 3]
    assert ids(conversations.without_orphan_head(df.filter("id < 2"))) == []


def brute_trim(rows, kept):
    if len(rows) <= kept + 1:
        return list(range(len(rows)))
    start = len(rows) - kept
    while start < len(rows) and rows[start][0] == "tool":
        start += 1
    return [0, *range(start, len(rows))]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 12])
def test_trim_agrees_with_brute_force(spark, n):
    rng = random.Random(n)
    for _ in range(3):
        rows = [(rng.choice(["user", "tool", "tool"]), "", None) for _ in range(n)]
        assert ids(conversations.trimmed_history(messages(spark, rows), 3)) == brute_trim(rows, 3)


def test_latest_messages(spark):
    df = messages(spark, [("user", "", None)] * 50)
    got = conversations.latest_messages(df)
    assert ids(got) == list(range(10, 50))
    assert got.filter("position = 1").first()["id"] == 10


def test_call_assembly(spark):
    rows = [("g", 0, 2, None, None, '1}'), ("g", 0, 1, "i1", "n1", '{"a":'), ("g", 0, 3, "i2", None, ""), ("g", 1, 1, None, "m", "")]
    df = spark.createDataFrame(rows, "call_group STRING, call_index INT, seq INT, id STRING, name STRING, fragment STRING")
    calls = conversations.assembled_calls(df)
    assert values(calls, "call_index", "id", "name", "arguments") == [(0, "i2", "n1", '{"a":1}'), (1, "call_1", "m", "")]
    text = conversations.calls_as_json(calls).first()["tool_calls"]
    assert text == (
        '[{"id":"i2","type":"function","function":{"name":"n1","arguments":"{\\"a\\":1}"}},'
        '{"id":"call_1","type":"function","function":{"name":"m","arguments":"{}"}}]'
    )


def test_segments_concatenate_to_the_text(spark):
    docs = spark.createDataFrame([(1, "aa.bb\ncccccc"), (2, ""), (3, "x")], "doc_id INT, text STRING")
    parts = documents.segments(docs, limit=5)
    assert values(parts) == [(1, 1, 3, "aa.bb\n"), (1, 2, 3, "ccccc"), (1, 3, 3, "c"), (3, 1, 1, "x")]
    assert values(documents.recombined(parts.filter("doc_id = 3"))) == [(3, "第 1 段总结:\nx")]
