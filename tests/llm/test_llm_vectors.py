"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from llm_cases import table

from forecourt.llm import embedding_dedup, queries
from forecourt.llm.embedding_dedup import near_duplicates


def slow(rows, cosine=0.95):
    """vec_id -> (links, component) over (vec_id, vector) with distinct numbers."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = {}
    for i, (vec_id, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), vec_id), vec_id)
    return {vec_id: (links[i], smallest[root(i)]) for i, (vec_id, _) in enumerate(rows)}


def result(df):
    found = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_query_agrees_with_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    assert result(queries.op1_embedding_dedup(spark, "/root/testdata/sf0.001")) == slow(rows)


@pytest.mark.parametrize("home,query", [(1024, 2048), (7, 5)])
def test_dense_groups_in_blocks(spark, monkeypatch, home, query):
    monkeypatch.setattr(embedding_dedup, "HOME_ROWS", home)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", query)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.5])).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(9)]  # exact copies
    assert result(near_duplicates(frame(spark, rows))) == slow(rows)


def test_cells_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 24))
    vectors = np.concatenate([base, base[:80] + 0.04 * rng.normal(size=(80, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert result(near_duplicates(frame(spark, rows))) == slow(rows)


def test_recall_at_the_threshold(spark):
    """Pairs that only just link are found even where the cells say little."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    pairs = 0.951 * base + np.sqrt(1 - 0.951**2) * aside
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, pairs]))]
    found = result(near_duplicates(frame(spark, rows)))
    linked = sum(found[1500 + i] == (1, i) for i in range(1500))
    assert linked >= 0.99 * 1500


def test_low_rank_in_many_dimensions(spark):
    """Pairs that only just link are all found where few directions hold all vectors."""
    rng = np.random.default_rng(6)
    dims, total = 256, 1500
    spread = np.arange(1, dims + 1) ** -1.5
    turned = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    draw = lambda: (rng.normal(size=(total, dims)) * spread) @ turned
    base = draw()
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = draw()
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    vectors = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * aside])
    linked = vectors @ vectors.T >= embedding_dedup.COSINE
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = result(near_duplicates(frame(spark, rows)))
    assert [found[i][0] for i in range(2 * total)] == (linked.sum(1) - 1).tolist()


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e280]), (12, [-1.0, 0.0]),
    ]
    found = result(near_duplicates(frame(spark, rows)))
    assert all(found[i] == (0, i) for i in (1, 2, 3, 4, 5, 6, 9, 12))
    assert all(found[i] == (3, 7) for i in (7, 8, 10, 11))
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows_and_null_numbers(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None)]
    found = sorted(near_duplicates(frame(spark, rows)).collect(), key=str)
    assert len(found) == 5
    assert sum(r["component_id"] == 5 and r["n_links"] == 2 for r in found) == 3
    assert sum(r["component_id"] is None and r["n_links"] == 0 for r in found) == 2
