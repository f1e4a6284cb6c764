"""Shards: whole groups, near-equal sizes, gapless slots."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import frame, odd_documents, table

from forecourt.llm import queries, sharding


def check(rows, texts, shards=24):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts
    )
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    return sizes


def test_query_keeps_the_law(spark):
    texts = [(r["doc_id"], r["text"]) for r in table("documents")]
    rows = queries.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    sizes = check(rows, texts)
    mean, largest = sum(sizes.values()) / 24, max(Counter(t for _, t in texts).items(), key=lambda x: len((x[0] or "").encode()) * x[1])
    assert max(sizes.values()) <= max(1.05 * mean, 1.01 * (len(largest[0].encode()) + 8) * largest[1])


def test_odd_rows(spark):
    docs = frame(spark, odd_documents())
    check(sharding.shards_by_bytes(docs).collect(), [(d, t) for d, t, _ in odd_documents()])
    assert sharding.shards_by_bytes(docs.limit(0)).count() == 0


def test_bundles_and_large_groups_together(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 400) + str(i), "s") for i in range(3000)]
    rows += [(10_000 + i, "copied text " * 20, "s") for i in range(500)]
    got = sharding.shards_by_bytes(frame(spark, rows), shards=5, bundle_share=1 / 50).collect()
    sizes = check(got, [(d, t) for d, t, _ in rows], 5)
    assert max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values()) / 5


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_bin(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 700, 3000)
    bins = sharding.best_fit_decreasing(sizes, 1000)
    free, expected = [], []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        if fits:
            f, b = min(fits)
            free[b] -= sizes[i]
        else:
            b = len(free)
            free.append(1000 - sizes[i])
        expected.append((i, b))
    assert all(bins[i] == b for i, b in expected)


def test_capacity_is_near_the_mean():
    sizes = np.random.default_rng(3).integers(1, 1000, 5000)
    capacity, bins = sharding.fixed_capacity(sizes, 24)
    loads = np.bincount(bins, weights=sizes, minlength=24)
    assert loads.max() <= capacity <= 1.001 * sizes.sum() / 24 + 1


def test_one_oversized_group_leaves_the_others_even():
    sizes = np.array([100_000, *[10] * 2300])
    _, bins = sharding.fixed_capacity(sizes, 24)
    loads = np.bincount(bins, weights=sizes, minlength=24)
    assert sorted(loads)[-2] == 1000 and loads.min() == 1000


def test_the_tree_stays_balanced_and_gives_the_tightest_bin():
    rng = random.Random(7)
    for order in (range(20_000), range(20_000, 0, -1), [5] * 20_000):
        tree, held = sharding.Remaining(), []
        for number, free in enumerate(order):
            tree.add(free, number)
            held.append((free, number))
        assert tree.depth() <= 60
        held.sort()
        for _ in range(3000):
            size = rng.randrange(25_000)
            at = bisect.bisect_left(held, (size, -1))
            assert tree.take(size) == (held.pop(at) if at < len(held) else None)
            if rng.random() < 0.5:
                item = (rng.randrange(20_000), rng.randrange(100_000, 10**9))
                tree.add(*item)
                bisect.insort(held, item)
        assert [tree.take(0) for _ in held] == held and tree.take(0) is None and tree.depth() == 0
