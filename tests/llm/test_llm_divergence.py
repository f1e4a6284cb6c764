"""Sorted word pointers, and the audit of sources, against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, odd_documents

from forecourt.llm import divergence
from forecourt.llm.divergence import Pointers, SCALE


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, min_docs=3, top=200):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for w in words_of(text):
            docs[lang, w].add(i)
            counts[lang, source][w] += 1
    out = set()
    for lang, sources in groups.items():
        kept = {w for (g, w), found in docs.items() if g == lang and len(found) >= min_docs}
        counted = {s: Counter({w: n for w, n in counts[lang, s].items() if w in kept}) for s in sources}
        whole = sum(counted.values(), Counter())
        p = lambda c: {w: 1 + SCALE * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        shares, q = {s: p(counted[s]) for s in sources}, p(whole)
        unlike = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(unlike(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-unlike(shares[s][w], q[w]), w.encode()) for w in counted[s] if shares[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def audited(docs, **options):
    rows = divergence.audit(docs, **options).drop("count", "share").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("small", [1, 2, 7, 1 << 15])
def test_pointers_are_sorted_as_words(small):
    random.seed(small)
    alphabet = ["a", "b", "é", "abcdefgh", "日本", "the", " ", " ", ".", "\x00"]
    for size in (0, 1, 30, 3000):
        texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(size // 10)]
        raw = np.frombuffer("".join(texts).encode().translate(divergence._LETTERS), np.uint8)
        breaks = np.cumsum([0, *[len(t.encode()) for t in texts]])[:-1]
        found = Pointers.of(raw, breaks)
        order, first = found.sort(small)
        expected = [w.encode() for t in texts for w in words_of(t)]
        mine = [found.letters[s : s + n].tobytes() for s, n in zip(found.starts, found.sizes)]
        assert mine == expected
        assert order.tolist() == sorted(range(len(mine)), key=lambda i: (mine[i], i))
        ordered = [mine[i] for i in order]
        assert first.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(len(mine))]
        assert found.joined(order, 1).to_pylist() == [w.decode() for w in ordered]


def test_shards_count_documents_and_words():
    rows = [("en", "a", "Go go, stop"), ("en", "b", "go"), ("en", "a", "go"), ("de", "a", ""), ("en", "a", "stopgo")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows])
    for some in (batch, pa.concat_batches([batch, batch]).slice(5)):
        found = {tuple(r.values()) for r in divergence._count_shard(some).to_pylist()}
        assert found == {("en", "a", "go", 2, 3), ("en", "b", "go", 1, 1), ("en", "a", "stop", 1, 1), ("en", "a", "stopgo", 1, 1)}


def documents(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string")


@pytest.mark.parametrize("block", [1, 2, 512])
def test_audit_as_by_plain_counting(spark, block):
    random.seed(5)
    vocabulary = [f"w{chr(97 + i % 26)}{'x' * (i % 11)}" for i in range(60)]
    rows = []
    for i in range(160):
        lang, source = random.choice(["en", "en", "fr", None]), random.choice(["s1", "s1", "s1", "s2", "S3", "é4", None])
        rows.append((lang, source, " ".join(random.choices(vocabulary[: 20 + 40 * (i % 2)], k=random.randint(0, 30)))))
    rows += [("it", "one", "alone alone"), ("la", "x", None), ("la", "y", ""), ("en", "empty", "")]
    assert audited(documents(spark, rows), block=block) == plain(rows)


def test_one_word_in_all_texts_and_the_cut_of_ranks(spark):
    rows = [("en", f"s{i % 3}", "the " * 500 + " ".join(f"{chr(97 + j % 26) * (1 + j // 26)}" for j in range(i, i + 60))) for i in range(60)]
    assert audited(documents(spark, rows), top=5) == plain(rows, top=5)


def test_odd_documents(spark):
    rows = odd_documents()
    docs = frame(spark, rows)
    assert audited(docs, min_docs=2) == plain([("en", s, t) for _, t, s in rows], 2)
    assert audited(docs.limit(0)) == set()
    small = divergence.term_counts(docs.selectExpr("lang", "coalesce(source, '') source", "coalesce(text, '') text"), shard_bytes=100)
    whole = divergence.term_counts(docs.selectExpr("lang", "coalesce(source, '') source", "coalesce(text, '') text"))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
