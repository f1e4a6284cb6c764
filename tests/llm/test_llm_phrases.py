"""Phrases against plain counting; passes that must mend a sample that says nothing."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, odd_documents
from pyspark.sql import functions as F

from forecourt.llm import phrases
from forecourt.llm.phrases import Sieve, Slice


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, words, out = defaultdict(Counter), Counter(), set()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            words[lang] += len(ws)
            for n in range(1, 5):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    for lang, f in counts.items():
        big = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in big.items():
            around = [c for q, c in big.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= 80 * a for c in around):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, words[lang], -score))
    return out


def some_texts(seed, n=120):
    random.seed(seed)
    names = ["new", "york", "city", "hall", "the", "of", "é", "日本", "a" * 300, "b" * 300 + "c", "x"]
    stock = ["new york city hall", "of the", "New  York\tcity", "a x a x a x"]
    texts = []
    for _ in range(n):
        parts = [random.choice(stock) if random.random() < 0.5 else " ".join(random.choices(names, k=3)) for _ in range(8)]
        texts.append("".join(p + random.choice([" ", ", ", "\n", ". ", "\x0b", " "]) for p in parts))
    return texts


def documents(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least, top", [(5, 2000), (30, 10)])
def test_collocations_as_by_plain_counting(spark, least, top):
    rows = [(random.Random(i).choice(["en", "en", "fr", None, ""]), t) for i, t in enumerate(some_texts(1))] + [("de", None), ("de", "")]
    assert found(phrases.collocations(documents(spark, rows), min_count=least, top=top)) == plain(rows, least, top)


@pytest.mark.parametrize("sample", [False, True])
def test_passes_close_whatever_the_sample_said(spark, sample):
    rows = [("en", t) for t in some_texts(2)]
    texts = documents(spark, rows).withColumn("mine", F.lit(sample))
    keys = phrases.frequent_keys(texts, F.col("mine"), 1.0, 10)
    counts = {(r["phrase"], r["f"]) for r in phrases.phrase_counts(texts, keys, 10).filter("size > 0").collect()}
    every = Counter()
    for _, t in rows:
        for ws in pieces(t):
            for n in range(1, 5):
                every.update(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    assert counts == {(p, c) for p, c in every.items() if c >= 10}
    assert keys.filter("key & 3 = 3").count() >= sum(1 for p, c in counts if p.count(" ") == 3)


def test_a_phrase_in_a_third_of_all_texts_and_slices_of_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 200)
    rows = [("en", "all rights reserved by the owner " * 20)] * 40 + [("en", t) for t in some_texts(3, 60)]
    assert found(phrases.collocations(documents(spark, rows))) == plain(rows)


def test_words_with_one_hash_are_told_apart():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "text": ["go to go and to the longest_of_words", "go longest_of_words longest_of_word"]})
    words = Slice(batch)
    ids = words.found.distinct(np.zeros(len(words.keys), np.uint64), words.lang)
    named = [(int(k), words.found.word(i)) for i, k in enumerate(words.lang)]
    assert [[a == b for b in ids] for a in ids] == [[a == b for b in named] for a in named]


def test_sieve_passes_all_its_keys_and_few_others(spark):
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(0, 1 << 63, 50_000, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    keys = spark.createDataFrame([(int(k),) for k in inside.view(np.int64)], "key bigint")
    for most in (phrases.MAX_CELLS, 64):
        sieve = Sieve.of(keys, most)
        assert len(sieve.cells) <= most and sieve.passes(inside).all()
    assert Sieve.of(keys).passes(outside).mean() < 0.05


def test_odd_documents(spark):
    rows = odd_documents()
    docs = frame(spark, rows)
    assert found(phrases.collocations(docs, min_count=3)) == plain([("en", t) for _, t, _ in rows], 3)
    assert found(phrases.collocations(docs.limit(0))) == set()
