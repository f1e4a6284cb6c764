"""SimHash near-duplicates against all pairs."""

import random

import pytest
import xxhash
from llm_cases import frame, odd_documents, table

from forecourt.llm import queries, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    """prints: key -> fingerprint; the smallest key of each key's component."""
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def test_query_agrees_with_all_pairs(spark):
    prints = {r["doc_id"]: slow_print(r["text"]) for r in table("documents")}
    roots = slow_components(prints)
    rows = queries.op10_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        k: (f"{p:016x}", roots[k]) for k, p in prints.items()
    }
    assert len(rows) == len(prints)


@pytest.mark.parametrize("cell_rows", [1, 4, 128])
def test_crowded_cells_lose_no_link(spark, cell_rows):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            flips = rng.sample(range(64), rng.randint(1, 4))
            prints.add(c ^ sum(1 << b for b in flips))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame_ = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = simhash.link_components(frame_, 2, cell_rows).collect()
    expected = slow_components({p: p & (1 << 64) - 1 for p in signed})
    groups = lambda pairs: sorted(sorted(k for k, r in pairs if r == root) for root in {r for _, r in pairs})
    assert groups([(r["fp"], r["root"]) for r in got]) == groups(list(expected.items()))


def test_odd_rows(spark):
    rows = odd_documents()
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["_doc"], set()).add((r["fp"], r["component_id"]))
    assert by_id[1] == by_id[2] and next(iter(by_id[1]))[1] == 1
    assert by_id[3] == by_id[4] == by_id[5] == {(0, 3)}  # no words: fingerprint zero, linked


def test_one_of_each_group_stays(spark):
    docs = frame(spark, odd_documents())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert [i[1] for i in ids if not i[0]] == [1, 3, 6, 7, 7, 8]


def test_empty_table(spark):
    docs = frame(spark, odd_documents()).limit(0)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_only_null_numbers(spark):
    docs = frame(spark, [(None, "a b c d", "x"), (None, "a b c d", "x"), (None, "q r s t u v", "x")])
    assert simhash.keep_one(docs).count() == 2


def test_odd_bound_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.midpoint_edges(spark.createDataFrame([(1,)], "fp bigint"), 3)
