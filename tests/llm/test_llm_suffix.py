"""Repeated passages against a table of all windows."""

import random
from collections import defaultdict

import numpy as np
from llm_cases import frame, odd_documents, table

from forecourt.llm import queries, suffix_dedup


def slow(rows, passage=50):
    where = defaultdict(list)
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        for i in range(len(words) - passage + 1):
            where[tuple(words[i : i + passage])].append((doc, i))
    places = defaultdict(list)
    for found in where.values():
        if len(found) > 1:
            for k, (doc, i) in enumerate(sorted(found)):
                places[doc, k == 0].append(i)
    spans = set()
    for (doc, original), at in places.items():
        at.sort()
        start = at[0]
        for a, b in zip(at, [*at[1:], None]):
            if b is None or b - a > passage:
                spans.add((doc, start, a + passage - start, original))
                start = b
    return spans


def result(df):
    return {tuple(r) for r in df.select("_doc", "start", "words", "original").collect()}


def test_query_agrees_with_all_windows(spark):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = queries.op4_suffix_dedup(spark, "/root/testdata/sf0.001").withColumnRenamed("doc_id", "_doc")
    assert result(got) == slow(rows)


def test_planted_passages(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(100000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for doc in range(30):
        words = [word() for _ in range(rng.randrange(30, 90))]
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(words))
            words[at:at] = p
        rows.append((doc, " ".join(words)))
    rows.append((100, " ".join(["same"] * 300)))  # a text that repeats itself
    expected = slow(rows)
    assert result(suffix_dedup.passages(frame(spark, [(d, t, "x") for d, t in rows]))) == expected


def test_neighbours_that_are_not_nearest_in_front(spark):
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    left, other, middle = word(24), word(24), word(26)
    texts = [(left, word(40)), (other, word(40)), (left, word(40)), (other, word(40)), (word(24), word(40)), (left, word(3))]
    rows = [(i, " ".join([*word(30), *a, *middle, *b])) for i, (a, b) in enumerate(texts)]
    got = result(suffix_dedup.passages(frame(spark, [(d, t, "x") for d, t in rows])))
    assert got == slow(rows) and len(got) == 5


def test_many_small_overlaps(spark):
    rng = random.Random(5)
    parts = [[f"{k}_{rng.randrange(9)}" for k in range(rng.randrange(3, 12))] for _ in range(12)]
    rows = []
    for doc in range(120):
        words = [w for _ in range(rng.randrange(1, 9)) for w in rng.choice(parts)]
        rows.append((doc, " ".join([*words, "long" * rng.randrange(1, 4) * 9])))
    rows += [(200, "a " * 100), (201, "a " * 90), (202, rows[3][1])]
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = result(suffix_dedup.passages(frame(spark, [(d, t, "x") for d, t in rows]), passage=12, span=5))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == slow(rows, 12)


def test_a_common_start_is_counted_in_words():
    assert suffix_dedup.common_words(b"ab c d ", b"ab c e ") == 2
    assert suffix_dedup.common_words(b"ab ", b"a ") == suffix_dedup.common_words(b"", b"a ") == 0
    assert suffix_dedup.common_words(b"a b ", b"a b ") == 2


def judged(rows, passage=4, span=2):
    neighbours = suffix_dedup.Neighbours(passage, span)
    return [v for r in sorted(rows) for v in neighbours.add(*r)] + neighbours.end()


def test_verdicts_by_neighbours():
    edge = [(b"0 0 0 0 ", b"", 0, 0, 0), (b"z z z z ", b"", 0, 0, 9)]
    found = judged([*edge, (b"a b c d ", b"x ", 2, 0, 5), (b"a b c d ", b"x ", 1, 0, 7), (b"a b c d ", b"x ", 1, 0, 7)])
    # Two that agree in all words; the first and last run of a task are given out.
    assert [v for v in found if v[0] is None] == [(None, 2, 0, 4, 2, None, False), (None, 1, 0, 6, 2, None, True)]
    assert [v[3] for v in found if v[0] is not None] == [0, 9]
    # Extended: of the windows at 0 and 1 before, the first ends in another word.
    found = judged([*edge, (b"a b c d ", b"x ", 2, 0, 5), (b"a b c e ", b"x ", 1, 0, 7)])
    assert [v for v in found if v[0] is None] == [(None, 2, 0, 4, 1, None, False), (None, 1, 0, 6, 1, None, True)]
    # Three kinds: their windows are given out.
    found = judged([*edge, *[(b"a b c %d " % i, b"x ", i, 0, 5) for i in range(3)]])
    assert not [v for v in found if v[0] is None] and len(found) == 2 + 3 * 2


def test_retained_positions_depend_on_content_alone():
    words = [b"%d" % (i * i % 1009) for i in range(400)]
    whole = set(suffix_dedup.Suffixes(words, {}).retained().tolist())
    part = suffix_dedup.Suffixes(words[100:300], {}).retained() + 100
    assert set(part.tolist()) <= whole
    assert len(whole) < 400 / 6


def test_run_hashes_are_equal_only_for_equal_runs():
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    hashes = suffix_dedup.Suffixes(words, {}).runs(2)
    assert hashes[0] == hashes[2] == hashes[5]
    assert len(np.unique(hashes)) == 4


def test_cutting_keeps_the_rest():
    assert suffix_dedup.cut_out("a b  c\nd e", [1], [2]) == "a d e"
    assert suffix_dedup.cut_out("a b", [0], [2]) == ""
    assert suffix_dedup.cut_out(" é b c ", [2, 0], [1, 1]) == " b "


def test_odd_rows_and_removal(spark):
    rows = odd_documents()
    long = next(t for d, t, _ in rows if d == 6)
    tail = "a tail of its own"
    docs = frame(spark, [*rows, (20, long + " " + tail, "c"), (21, long, "c")])
    kept = suffix_dedup.without_copies(docs, n_chars="n_chars")
    assert kept.columns == docs.columns
    found = {(r["doc_id"], r["text"]): r["n_chars"] for r in kept.collect()}
    assert (6, long) in found and (20, tail) in found and found[20, tail] == len(tail)
    assert not any(d == 21 for d, _ in found)  # nothing of it was left
    assert len([1 for d, t in found if d == 7]) == 2 and (3, None) in found and (4, "") in found
    assert suffix_dedup.passages(docs.limit(0)).count() == 0
    assert suffix_dedup.without_copies(docs.limit(0)).count() == 0
