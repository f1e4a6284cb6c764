"""A key with a third of all rows: whole results, and few rows through the shuffle."""

from collections import Counter

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from forecourt.operators import conversations, dedup, ranking, stats, words
from forecourt.streaming.state import latest_per_key

ROWS, TASKS, KEYS = 60_000, 16, 50


@pytest.fixture
def skewed(spark):
    """Rows spread over tasks; every third belongs to key 0."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % KEYS)
    yield spark.range(0, ROWS, 1, TASKS).withColumn("k", key.cast("int"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def key_of(i):
    return 0 if i % 3 == 0 else i % KEYS


def shuffled_rows(df):
    """Rows written to shuffles while the frame was collected."""
    def walk(node):
        found = [node.metrics().apply("shuffleRecordsWritten").value()] if "Exchange" == node.nodeName() else []
        children = node.children()
        for i in range(children.size()):
            found += walk(children.apply(i))
        return found

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_the_counter_sees_shuffled_rows(skewed):
    moved = skewed.repartition(4, "k")
    moved.collect()
    assert shuffled_rows(moved) == ROWS


def test_counts(skewed):
    top = stats.top_counts(skewed, "k", KEYS)
    expected = Counter(map(key_of, range(ROWS)))
    assert dict(tuple(r) for r in top.collect()) == dict(expected)
    assert shuffled_rows(top) <= TASKS * KEYS


def test_words(skewed):
    lines = skewed.select(F.concat_ws(" ", F.lit("the"), F.col("k").cast("string")).alias("value"))
    counted = words.token_count(lines)
    got = {r["word"]: r["freq"] for r in counted.collect()}
    assert got["the"] == ROWS and got["0"] == Counter(map(key_of, range(ROWS)))[0]
    assert shuffled_rows(counted) <= TASKS * (KEYS + 1)


def test_first_rows(skewed):
    once = dedup.dedup_columns(skewed, "k", [F.col("id")])
    rows = once.collect()
    firsts = {}
    for i in range(ROWS):
        firsts.setdefault(key_of(i), i)
    assert {r["k"]: r["id"] for r in rows} == firsts and len(rows) == len(firsts)
    assert shuffled_rows(once) <= TASKS * KEYS


def test_distinct_lines_by_field(skewed):
    lines = skewed.select(F.concat_ws(",", "k", F.lpad(F.col("id").cast("string"), 6, "0")).alias("value"))
    once = dedup.dedup_lines(lines, "1")
    assert once.collect() and once.count() == KEYS
    assert shuffled_rows(once) <= TASKS * KEYS


def test_latest_rows(skewed):
    newest = latest_per_key(skewed, ["k"], ["id"])
    lasts = {key_of(i): i for i in range(ROWS)}
    assert {r["k"]: r["id"] for r in newest.collect()} == lasts
    assert shuffled_rows(newest) <= TASKS * KEYS


@pytest.fixture
def chats(skewed):
    role = F.when(F.col("id") % 4 == 0, "tool").otherwise("user")
    return skewed.select(
        F.col("k").cast("string").alias("session_id"), "id", role.alias("role"),
        F.lit("x").alias("content"), F.lit(None).cast("string").alias("tool_calls"),
    )


def sessions():
    found = {}
    for i in range(ROWS):
        found.setdefault(str(key_of(i)), []).append(i)
    return found


def test_last_messages(chats):
    last = conversations.latest_messages(chats)
    got = Counter(r["session_id"] for r in last.collect())
    assert all(got[s] == min(len(ids), 40) for s, ids in sessions().items())
    assert shuffled_rows(last) <= TASKS * KEYS * 40


def test_trimmed_sessions(chats):
    trimmed = conversations.trimmed_history(chats)
    expected = []
    for s, ids in sessions().items():
        tail = ids[-30:]
        while tail and tail[0] % 4 == 0:
            tail = tail[1:]
        expected += [(s, i) for i in [ids[0], *tail]]
    assert sorted((r["session_id"], r["id"]) for r in trimmed.collect()) == sorted(expected)
    assert shuffled_rows(trimmed) <= TASKS * KEYS * 33


def test_numbers_spread_over_tasks(skewed):
    numbered = ranking.number_rows(skewed, [F.col("k"), F.col("id")], "n")
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, ROWS, ROWS)
    hot = numbered.filter("k = 0").agg(F.max("n"), F.count("*")).first()
    assert hot[0] == hot[1]
    assert values(numbered.filter("n = 1").select("id", "k")) == [(0, 0)]


def test_many_rows_of_a_hot_key(skewed):
    """Beyond the planner's limit the rows of a key stay spread over tasks, and are the same."""
    df = skewed.withColumn("k", F.when(F.col("k") != 1, F.col("k")))
    got = ranking.last_per_key(df, ["k"], [F.col("id").desc()], 15_000)
    rows = {}
    for i in range(ROWS - 1, -1, -1):
        k = key_of(i) if key_of(i) != 1 else None
        mine = rows.setdefault(k, [])
        if len(mine) < 15_000:
            mine.append(i)
    expected = {(k, i, place) for k, mine in rows.items() for place, i in enumerate(mine, 1)}
    assert {(r["k"], r["id"], r["back"]) for r in got.collect()} == expected
    # What is shuffled behind the sort by range is a row per key, range and task; no key is gathered.
    assert "row_number" not in plan_of(got)
    assert shuffled_rows(got) <= 2 * 8 * (KEYS + 8)
