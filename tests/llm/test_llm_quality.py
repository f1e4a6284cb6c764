"""Quality measures and verdicts against plain Python."""

import re
from collections import Counter

import pytest
from llm_cases import frame, odd_documents, table

from forecourt.llm import quality, queries


def slow(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def test_measures_agree_with_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    rows = queries.op8_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: r[k] for k in slow("")} == slow(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    rows = {r["doc_id"]: r for r in queries.op8_quality(spark, "/root/testdata/sf0.001").collect()}
    clean = [rows[d] for d, q in labels.items() if q == 1 and not rows[d]["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)


def test_odd_rows(spark):
    docs = frame(spark, odd_documents())
    rows = quality.verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert r["base_failed"] and not r["kept"] and r["n_words"] == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert quality.verdicts(docs.limit(0)).count() == 0
    assert quality.filtered(docs.limit(0)).count() == 0


def test_a_hopeless_host_loses_its_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad", "junk.example") for i in range(200)] + [(1000, clean, "junk.example")]
    rows += [(2000 + i, clean + f" {i}", "fine.example") for i in range(200)]
    found = {r["doc_id"]: r for r in quality.verdicts(frame(spark, rows)).collect()}
    assert not found[1000]["kept"] and not found[1000]["base_failed"]
    assert all(found[2000 + i]["kept"] for i in range(200))


@pytest.mark.parametrize("n,k,square,hosts", [(0, 0, 0.0, 0), (10, 0, 0.0, 2), (10, 10, 10.0, 1), (100, 30, 9.0, 5), (100, 30, 25.0, 5)])
def test_prior_has_the_mean_of_the_hosts(n, k, square, hosts):
    a, b = quality.beta_prior(n, k, square, hosts)
    assert a >= 0 and b >= 0 and a + b > 0
    if n:
        assert a / (a + b) == pytest.approx(k / n)


def test_no_python_in_the_plan(spark):
    plan = quality.filtered(frame(spark, odd_documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
