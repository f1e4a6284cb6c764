"""Token and address rules against plain Python on generated values."""

from conftest import values
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from forecourt.functions import names, text
from forecourt.operators import words

RELAXED = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def java_split(line, separator):
    """Inner empty parts stay, trailing ones go; an empty line has one empty part."""
    if line == "":
        return [""]
    parts = line.split(separator)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def mapped(spark, rows, build):
    df = spark.createDataFrame(list(enumerate(rows)), "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


@RELAXED
@given(st.lists(st.text(alphabet="a b,é", max_size=8), min_size=1, max_size=30))
def test_separated_tokens(spark, rows):
    for separator in " ,":
        got = mapped(spark, rows, lambda c: text.separated_tokens(c, separator))
        assert got == [java_split(r, separator) for r in rows]


@RELAXED
@given(st.lists(st.text(alphabet="ab \t\n\r\f", max_size=10), min_size=1, max_size=30))
def test_token_counts(spark, rows):
    lines = spark.createDataFrame([(r,) for r in rows], "value STRING")
    expected = {}
    for token in " ".join(rows).split():
        expected[token] = expected.get(token, 0) + 1
    assert dict(values(words.token_count(lines))) == expected


def parsed_address(value):
    s = value.strip("".join(map(chr, range(33))))
    s = s.split("://", 1)[1] if "://" in s else s
    s = s.split("/", 1)[0]
    colon = s.rfind(":")
    if colon > 0:
        digits = s[colon + 1 :]
        plain = digits[1:] if digits[:1] in ("+", "-") else digits
        good = plain.isascii() and plain.isdigit() and -(2**31) <= int(digits) < 2**31
        return s[:colon], int(digits) if good else names.DEFAULT_PORT
    return s or names.DEFAULT_HOST, names.DEFAULT_PORT


@RELAXED
@given(st.lists(st.text(alphabet="hx:/+-19. ", max_size=14), min_size=1, max_size=40))
def test_addresses(spark, rows):
    rows = [*rows, "ws://a://b:1", "h:", "h:-5", "a:b://c:2/d"]
    got = mapped(spark, rows, lambda c: F.struct(names.host(c), names.port(c)))
    assert [tuple(r) for r in got] == [parsed_address(r) for r in rows]


@RELAXED
@given(st.lists(st.text(alphabet="ab.", max_size=8), min_size=1, max_size=40))
def test_names(spark, rows):
    got = mapped(spark, rows, lambda c: F.struct(names.base_name(c), names.extension(c)))
    expected = [tuple(r.rsplit(".", 1)) if "." in r else (r, "") for r in rows]
    assert [tuple(r) for r in got] == expected
