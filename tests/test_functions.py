"""Scalar rules on pinned values."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from forecourt.functions import names, numbers, text


def column(spark, rows, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_tokens(spark):
    assert column(spark, ["  a b "], "STRING", text.whitespace_words) == [["", "a", "b", ""]]
    assert column(spark, ["  a b ", "", "\t\n"], "STRING", text.plain_tokens) == [["a", "b"], [], []]
    spaces = column(spark, ["a  b  ", "   ", ""], "STRING", lambda c: text.separated_tokens(c, " "))
    assert spaces == [["a", "", "b"], [], [""]]
    commas = column(spark, ["a,,b,,", ",", "", ",a"], "STRING", lambda c: text.separated_tokens(c, ","))
    assert commas == [["a", "", "b"], [], [""], ["", "a"]]


def test_fields(spark):
    rows = ["x", "x,y", "a,,c", ""]
    assert column(spark, rows, "STRING", lambda c: text.field_at(c, 3)) == [None, None, "c", None]
    assert column(spark, rows, "STRING", lambda c: text.field_at(c, 1)) == ["x", "x", "a", ""]
    with pytest.raises(ValueError):
        text.field_at(F.lit("x"), 0)


def test_number_coercion(spark):
    rows = [" 12 ", "12.5", None, "x", "-3", "", "99999999999"]
    assert column(spark, rows, "STRING", numbers.int_or_zero) == [12, 0, 0, 0, -3, 0, 99999999999]
    assert column(spark, [2.9, -2.9, None], "DOUBLE", numbers.int_or_zero) == [2, -2, 0]
    assert column(spark, [" 1.5 ", "x", None], "STRING", numbers.double_or_zero) == [1.5, 0.0, 0.0]


def test_rounding(spark):
    rows = [-2.25, 2.25, 0.0, 1.04, 1.05]
    assert column(spark, rows, "DOUBLE", numbers.round_half_up_1) == [-2.2, 2.3, 0.0, 1.0, 1.1]
    rows = [1.005, 0.125, -0.125, 1234567.891, 2.0, 0.375]
    assert column(spark, rows, "DOUBLE", numbers.fixed_2) == ["1.00", "0.13", "-0.13", "1234567.89", "2.00", "0.38"]


def test_human_size(spark):
    rows = [0, 1023, 1024, 1536, 1048575, 1048576, 3365928]
    shown = column(spark, rows, "LONG", numbers.human_size)
    assert shown == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "3.2 MB"]


def test_leading_number(spark):
    rows = ["3.21MB", "7", " 2.5 GB", "MB", ".5", "1e2x", None]
    assert column(spark, rows, "STRING", numbers.leading_number) == [3.21, 7.0, 2.5, None, 0.5, 100.0, None]


def test_dates_in_text(spark):
    rows = ["销量 2025-03", "in 2024", "none", "2020 or 2021-05 or 2022-06-07", "id 120199", None, "1899"]
    expected = ["2025-03", "2024", None, "2022-06-07", "2019", None, None]
    assert column(spark, rows, "STRING", text.date_in_text) == expected


def test_names(spark):
    rows = ["a.b.csv", "x", "y.", ".hidden"]
    assert column(spark, rows, "STRING", names.file_type) == ["CSV", "", "", "HIDDEN"]
    assert column(spark, rows, "STRING", names.base_name) == ["a.b", "x", "y", ""]
    paths = ["/original_data", "/original_data/a", "/original_data_2/a", "/x/original_data/a"]
    zone = column(spark, paths, "STRING", lambda c: names.in_zone(c, names.ORIGINAL_ZONE))
    assert zone == [True, True, False, False]


def test_addresses(spark):
    rows = ["ws://h:99/x", "h:zz", "", "tcp://a:b:7", ":7", "h", " http://k/y:1 ", "h:99999999999"]
    hosts = ["h", "h", "127.0.0.1", "a:b", ":7", "h", "k", "h"]
    ports = [99, 9999, 9999, 7, 9999, 9999, 9999, 9999]
    assert column(spark, rows, "STRING", names.host) == hosts
    assert column(spark, rows, "STRING", names.port) == ports
    rows = ["ws://10.0.0.1:80/x", "wss://h/p", "h:1:2"]
    assert column(spark, rows, "STRING", names.socket_host) == ["10.0.0.1", "h/p", "h"]


def test_keys_and_stamps(spark):
    assert column(spark, ["a.b-c"], "STRING", names.dots_to_underscores) == ["a_b-c"]
    assert column(spark, ["a.b-c 1"], "STRING", names.safe_label) == ["a_b_c_1"]
    assert column(spark, ["a.b-c 1"], "STRING", names.safe_task_id) == ["abc1"]
    moment = [datetime.datetime(2025, 3, 4, 5, 6, 7)]
    assert column(spark, moment, "TIMESTAMP", names.iso_utc) == ["2025-03-04T05:06:07Z"]
    assert column(spark, moment, "TIMESTAMP", names.file_stamp) == ["20250304_050607"]
    assert column(spark, ["a%20b", "%E9%94%80", "%zz"], "STRING", names.decoded_name) == ["a b", "销", None]


def test_text_defaults(spark):
    rows = ["a", " \n", None, ""]
    assert column(spark, rows, "STRING", text.blank_default) == ["a"] + [text.EMPTY_TEXT_MESSAGE] * 3
    assert column(spark, rows, "STRING", text.is_blank) == [False, True, True, True]
    rows = ["x" * 300, "x" * 301, None]
    assert column(spark, rows, "STRING", text.short_text) == ["x" * 300, "x" * 300 + "...", ""]
    assert column(spark, ["\t a b\n"], "STRING", text.java_trim) == ["a b"]


def test_json_arguments(spark):
    rows = ['{"a": 1, "b": "x", "c": {"d": 1}, "e": null}', "[1]", "{bad", "", None, '"s"']
    parsed = column(spark, rows, "STRING", text.json_arguments)
    assert parsed[0] == {"a": "1", "b": "x", "c": '{"d":1}', "e": None}
    assert parsed[1:] == [{}] * 5


def brute_chunks(value, limit):
    """Piece by piece from the left, as the rule says."""
    pieces, rest = [], value
    while rest:
        size = len(rest)
        if size > limit:
            window = rest[: limit + 1]
            stop = max(window.rfind("."), window.rfind("\n"))
            size = stop + 1 if stop > 0 else limit
        pieces.append(rest[:size])
        rest = rest[size:]
    return pieces


def test_chunk_pin(spark):
    cut = column(spark, ["aa.bb\ncccccc", "", "abc"], "STRING", lambda c: text.chunks(c, 5))
    assert cut == [["aa.bb\n", "ccccc", "c"], [], ["abc"]]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.\n中😀", max_size=60), min_size=1, max_size=20), st.integers(1, 9))
def test_chunks_agree_with_brute_force(spark, texts, limit):
    cut = column(spark, texts, "STRING", lambda c: text.chunks(c, limit))
    assert cut == [brute_chunks(t, limit) for t in texts]
    assert all("".join(c) == t for c, t in zip(cut, texts))
    assert all(len(p) <= limit + 1 for c in cut for p in c)


def test_chunks_at_the_real_limit(spark):
    value = ("x" * 70_000) + "." + ("y" * 65_430) + "\n" + ("z" * 200_000)
    cut = column(spark, [value], "STRING", text.chunks)[0]
    assert cut == brute_chunks(value, text.SEGMENT_LIMIT)
