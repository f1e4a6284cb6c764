"""Physical plans: what is read, shuffled and broadcast."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import Window, functions as F

from forecourt import suite
from forecourt.operators import stats

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return plan_of(suite.all_queries()[name](spark, SF_DIR))


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_top_list_is_not_a_full_sort(spark):
    text = plan(spark, "a5_topn_brand")
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text and "rangepartitioning" not in text
    assert text.index("partial_count") > text.index("BroadcastHashJoin")  # counted below the join


def test_period_reaches_the_scan(spark):
    text = formatted(suite.all_queries()["p3_sales_month"](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_month_folders_are_pruned(spark):
    text = formatted(suite.all_queries()["p3_month_folders"](spark, SF_DIR))
    assert re.search(r"PartitionFilters: \[.*sale_month", text)


def test_point_lookup_reaches_the_scan(spark):
    text = formatted(suite.all_queries()["s10_point_lookup"](spark, SF_DIR))
    assert "EqualTo(o_orderkey,1)" in text


def test_catalog_does_not_read_contents(spark):
    text = formatted(suite.all_queries()["s11_file_catalog"](spark, SF_DIR))
    assert "content" not in text.split("ReadSchema")[1]


def test_word_count_reads_one_column_and_combines_early(spark):
    text = formatted(suite.all_queries()["a2_token_count"](spark, SF_DIR))
    assert "ReadSchema: struct<text:string>" in text
    assert "partial_count" in text


@pytest.mark.parametrize("name", ["a16_dedup_key", "w4_latest_40", "w5_trim_30", "w6_orphan_head_40"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    shuffles = text.count("Exchange hashpartitioning")
    assert re.findall(r"row_number\(\), \d+, Partial", text), text
    assert len(re.findall(r", Partial\n", text)) == shuffles


def test_source_total_reuses_the_grouped_exchange(spark):
    df = stats.top_counts_with_total(spark.read.parquet(f"{SF_DIR}/events.parquet"), "user_id", 3)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"]
WINDOW_IN_ONE_TASK = re.compile(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition")


def test_window_pattern_finds_a_window_without_keys(spark):
    rows = spark.range(5).repartition(2, "id")
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert WINDOW_IN_ONE_TASK.search(plan_of(numbered))


@pytest.mark.parametrize("name", sorted(suite.all_queries()))
def test_no_row_pairs_no_python_no_window_over_everything(spark, name):
    text = plan(spark, name)
    assert not [f for f in FORBIDDEN if f in text]
    # Allowed: numbering partitions, and rows after a limit.
    assert all("sum(_size" in m or "_n#" in m for m in WINDOW_IN_ONE_TASK.findall(text))


def test_hot_key_is_counted_before_the_join(spark):
    """A part with a third of all sales must not reach the join as single rows."""
    text = plan(spark, "a5_topn_brand")
    join = text.index("BroadcastHashJoin")
    assert text.index("HashAggregate(keys=[l_partkey", join) > join


def test_sorted_sales_can_split_a_hot_model(spark):
    text = plan(spark, "p3_sales_year")
    assert re.search(r"rangepartitioning\(model#\d+ ASC NULLS FIRST, sale_date", text)


def test_scalar_total_is_a_subquery(spark):
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("v"))
    text = plan_of(stats.share_of_total(df, "v"))
    assert "Subquery" in text and "Window" not in text
