"""Line deduplication against a quadratic version."""

import random

import pytest
from llm_cases import frame, odd_documents, table

from forecourt.llm import line_dedup, queries
from pyspark.sql import functions as F


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return a[p + 1 :] == b[p:]


def slow(rows, near=10):
    """(doc, line) -> (doc, line, edits) of the earliest match before."""
    lines = []
    for doc, text in sorted(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(line.encode().split())
            if words:
                lines.append((doc, i, words))
    first = {}
    for line in lines:
        first.setdefault(line[2], line)
    distinct = list(first.values())
    best = {}
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if len(x[2]) >= near and len(y[2]) >= near and one_edit(x[2], y[2]):
                best[x[2]] = y
                break
    found = {}
    for line in lines:
        origin, edits = first[line[2]], 0
        other = best.get(line[2])
        if other and other[:2] < origin[:2]:
            origin, edits = other, 1
        if origin[:2] < line[:2]:
            found[line[:2]] = (*origin[:2], edits)
    return found


def result(df):
    return {(r["_doc"], r["line"]): (r["first_doc"], r["first_line"], r["edits"]) for r in df.collect()}


def test_query_agrees_with_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = queries.op5_line_dedup(spark, "/root/testdata/sf0.001").withColumnRenamed("doc_id", "_doc")
    assert result(got) == slow(rows)


def test_random_edits(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(6)}" for _ in range(rng.choice([9, 10, 11, 19, 20, 21, 40]))] for _ in range(12)]
    lines = []
    for words in base * 6:
        words = list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(words))
            kind = rng.randrange(3)
            if kind == 0:
                words[at] = f"w{rng.randrange(6)}"
            elif kind == 1:
                del words[at]
            else:
                words.insert(at, f"w{rng.randrange(6)}")
        lines.append(" ".join(words))
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4)]
    docs = frame(spark, [(d, t, "x") for d, t in rows])
    expected = slow(rows)
    assert sum(e[2] for e in expected.values()) > 5
    assert result(line_dedup.duplicates(docs)) == expected


def test_short_lines_by_parameter(spark):
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 7))) for _ in range(90)]
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(30)]
    docs = frame(spark, [(d, t, "x") for d, t in rows])
    for near in (3, 4):
        expected = slow(rows, near)
        assert expected != slow(rows)
        assert result(line_dedup.duplicates(docs, near_words=near)) == expected
    with pytest.raises(ValueError):
        line_dedup.duplicates(docs, near_words=2)


def test_variants_of_a_long_line_match_slices(spark):
    words = [f"w{i}" for i in range(57)]
    lines = spark.createDataFrame([(0, words), (1, words[:30] + words[31:])], "id int, w array<string>")
    keys = {(r["id"], r["place"]): r["key"] for r in line_dedup.variants(lines).collect()}
    assert keys[0, 30] == keys[1, -1]
    assert len({keys[0, i] for i in range(57)}) == 57


def test_one_edit_expression(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = [rng.choice("ab") for _ in range(rng.randrange(0, 6))]
        b = [rng.choice("ab") for _ in range(rng.randrange(0, 6))]
        rows.append((a, b, a == b or one_edit(tuple(a), tuple(b))))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, e boolean")
    assert df.filter(line_dedup.one_edit(F.col("a"), F.col("b")) != F.col("e")).count() == 0


def test_odd_rows_and_removal(spark):
    docs = frame(spark, odd_documents() + [(9, "short\nunique line\n  short ", "d"), (10, "kept\nshort\nalso kept", "d")])
    kept = line_dedup.deduplicated(docs, n_chars="n_chars")
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect() if r["doc_id"] not in (None, 5, 7)}
    assert 2 not in rows  # all its lines are in 1
    assert rows[9]["text"] == "unique line" and rows[9]["n_chars"] == 11
    assert rows[10]["text"] == "kept\nalso kept"
    assert rows[3]["text"] is None and rows[4]["text"] == ""
    assert line_dedup.duplicates(docs.limit(0)).count() == 0
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = frame(spark, odd_documents())
    plan = line_dedup.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
