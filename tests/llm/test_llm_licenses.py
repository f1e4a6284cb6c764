"""Licence phrases against a plain search over words; expressions against hand-made cases."""

import random
import re
import time

import pytest
from llm_cases import SF_DIR, frame, odd_documents, table

from forecourt.llm import license_scan
from forecourt.llm.license_scan import COPYLEFT, FILE_COPYLEFT, PERMISSIVE, RESTRICTED, Rules, Scanner, evaluate


def plain(text):
    """Words, base places, and labels of all phrases, word by word."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {p: places(p) for p in license_scan.BASE_PHRASES}
    labels = {label for p, label, _ in license_scan.PHRASES if places(p)}
    starts = [s for found in base.values() for s in found]
    base_labels = {license_scan.BASE_PHRASES[p] for p, found in base.items() if found}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)),
    )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]


def summary(spark, docs):
    return license_scan.summary(license_scan.scan(docs))


def test_all_documents_as_by_plain_search(spark):
    rows = table("documents")
    found = {r["doc_id"]: r for r in summary(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    assert len(found) == len(rows)
    for row in rows:
        mine = found[row["doc_id"]]
        assert tuple(mine[c] for c in COLUMNS) == plain(row["text"])
        assert 0 <= mine["score"] <= 1 and (mine["score"] > 0) == bool(mine["labels"])
    assert any(r["labels"] for r in found.values()) and any(not r["labels"] for r in found.values())


def test_random_texts_as_by_plain_search():
    random.seed(3)
    scanner = Scanner(Rules.standard())
    pieces = ["cc", "by", "nc", "general", "public", "license", "all", "rights", "reserved", "mit", "version", "2", "0", "é", "日本"]
    glue = [" ", "\n", "-", ", ", "/", "\x00", "", " "]
    for _ in range(500):
        text = "".join(random.choice(pieces).swapcase() + random.choice(glue) for _ in range(random.randint(0, 40)))
        n, found, _ = scanner.scan(text.encode())
        base = [f for f in found if f[1]]
        want = plain(text)
        assert (n, len(base)) == want[:2]
        assert ",".join(sorted({f[0] for f in found})) == want[5]
        if base:
            assert (min(f[2] for f in base), max(f[2] for f in base)) == want[2:4]


@pytest.mark.parametrize(
    "text, labels, free, well",
    [
        ("mit", {"mit"}, PERMISSIVE, True),
        ("mit or gpl-3.0-only", {"mit", "gpl-3.0-only"}, PERMISSIVE, True),
        ("mit and gpl-3.0-only", {"mit", "gpl-3.0-only"}, COPYLEFT, True),
        ("cc-by-nc-4.0 or mit and gpl-2.0", {"cc-by-nc-4.0", "mit", "gpl-2.0"}, COPYLEFT, True),
        ("(cc-by-nc-4.0 or mit) and gpl-2.0", {"cc-by-nc-4.0", "mit", "gpl-2.0"}, COPYLEFT, True),
        ("(mit or gpl-2.0) and cc-by-nc-4.0", {"cc-by-nc-4.0", "mit", "gpl-2.0"}, RESTRICTED, True),
        ("mit or gpl-2.0 and cc-by-nc-4.0", {"cc-by-nc-4.0", "mit", "gpl-2.0"}, PERMISSIVE, True),
        ("gpl-2.0 with classpath-exception-2.0", {"gpl-2.0"}, FILE_COPYLEFT, True),
        ("gpl-2.0 with classpath-exception-2.0 and mit", {"gpl-2.0", "mit"}, FILE_COPYLEFT, True),
        ("mit/apache-2.0.", {"mit", "apache-2.0"}, PERMISSIVE, True),
        ("mit is what we chose", {"mit"}, PERMISSIVE, True),
        ("licenseref-own", {"other"}, 0.0, True),
        ("(mit or (gpl-2.0", {"mit", "gpl-2.0"}, PERMISSIVE, False),
        ("mit and (", {"mit"}, PERMISSIVE, False),
        ("mit or", {"mit"}, PERMISSIVE, False),
    ],
)
def test_expressions(text, labels, free, well):
    value, valid = evaluate(text)
    assert (value.labels, value.free, valid) == (labels, free, well)


@pytest.mark.parametrize("text", ["", "and mit", "(((", "() mit", ") mit", "with mit", "* mit"])
def test_no_expression(text):
    assert evaluate(text) == (None, False)


def test_deep_and_many_expressions_take_linear_time():
    scanner, start = Scanner(Rules.standard()), time.time()
    assert scanner.scan(b"spdx-license-identifier: " + b"(" * 100_000 + b"mit" + b" or mit)" * 100_000)[2][0][1] == ["mit"]
    assert len(scanner.scan(b"spdx-license-identifier: mit or " * 30_000)[2]) == 30_000
    assert scanner.scan(b"cc by " * 200_000)[1][-1][2] == 399_998
    assert time.time() - start < 20


def test_tags_end_with_their_line(spark):
    rows = [(1, "# SPDX-License-Identifier: MIT OR\nApache-2.0 é", "a"), (2, "/* SPDX-License-Identifier: (MIT AND LicenseRef-x) */ or gpl", "a")]
    found = {r["doc_id"]: r for r in summary(spark, frame(spark, rows)).collect()}
    assert (found[1]["labels"], found[1]["score"]) == ("mit", 0.6)
    assert (found[2]["labels"], found[2]["score"], found[2]["free"]) == ("mit,other", 0.5, 0.0)


def test_odd_documents(spark):
    rows = odd_documents()
    found = summary(spark, frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), *[r[c] or 0 for c in COLUMNS[:2]]) for r in found) == sorted(
        (str(d), *plain(t)[:2]) for d, t, _ in rows
    )
    assert summary(spark, frame(spark, rows).limit(0)).count() == 0
