"""The language model: gradients, proper probabilities, counts, and held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, odd_documents, table

from forecourt.llm import lm_score, queries


def slow_base(texts):
    """doc -> (held out, tokens, known, N, base score) as the formula says."""
    counts, ends = Counter(), 0
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for doc, text in texts:
        if not out(doc):
            counts.update((text or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    found = []
    for doc, text in texts:
        words = (text or "").encode().lower().split()
        c = [counts[w] for w in words] + [ends]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c)
        found.append((str(doc), out(doc), len(c), sum(x > 0 for x in c), total, round(base, 6)))
    return sorted(found)


def fields(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_query_counts_and_gains(spark):
    texts = [(r["doc_id"], r["text"]) for r in table("documents")]
    rows = queries.op7_lm_score(spark, "/root/testdata/sf0.001").collect()
    assert fields(rows) == slow_base(texts)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows_and_small_dictionary(spark, monkeypatch):
    docs = frame(spark, odd_documents())
    whole = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.scored(docs).collect()}
    assert fields(lm_score.scored(docs).collect()) == slow_base([(d, t) for d, t, _ in odd_documents()])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in whole.values())
    assert lm_score.scored(docs.limit(0)).count() == 0


def test_no_training_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = lm_score.scored(frame(spark, [(held, "some words here", "x")])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows] == [(4, 0, 0)]
    assert math.isfinite(rows[0]["score"]) and math.isfinite(rows[0]["base_score"])


def network(n=23, hidden=5):
    return lm_score.Network(np.arange(n, 0, -1).astype(float), hidden)


def test_probabilities_sum_to_one():
    net = network()
    states = np.random.default_rng(0).normal(size=(4, 5)).astype(np.float32)
    total = sum(np.exp(net.output(states, np.full(4, s))) for s in range(net.n))
    assert total == pytest.approx(np.ones(4), abs=1e-5)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, 23, (6, 3)), rng.integers(0, 23, (6, 3))
    end = 22
    inputs[3, 1] = end  # a text ends inside the window

    def loss(net):
        state, total = np.zeros((3, 5)), 0.0
        for t in range(6):
            state = state * (inputs[t] != end)[:, None]
            state = net.step(inputs[t], state)[0]
            total -= net.output(state, targets[t]).sum()
        return total / 18

    def double():
        net = network()
        net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
        return net

    net = double()
    before = {k: v.copy() for k, v in net.weights.items()}
    net.squares = {k: np.full_like(v, 1e12) for k, v in net.weights.items()}  # steps tell the gradient
    net.learn(inputs, targets, np.ones((6, 3), bool), np.zeros((3, 5)), end)
    for name, w in before.items():
        moved = (w - net.weights[name]) * 1e6 / lm_score.RATE
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            probe, shift = double(), 1e-5
            probe.weights[name][at] += shift
            up = loss(probe)
            probe.weights[name][at] -= 2 * shift
            assert moved[at] == pytest.approx((up - loss(probe)) / (2 * shift), abs=2e-4), name


def test_state_is_carried_over_windows_and_batches():
    net = network()
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 22, n), 22) for n in (0, 1, 5, 64, 65, 300, 2, 64)]
    order = net.place

    def alone(text):
        state, last, total = np.zeros((1, 5), np.float32), order[22], 0.0
        for s in order[text]:
            state = net.step(np.array([last]), state)[0]
            total += net.output(state, np.array([s]))[0]
            last = s
        return total / math.log(10)

    assert net.scores(texts, 22, side_by_side=3) == pytest.approx([alone(t) for t in texts], rel=1e-4)


def test_learning_a_pattern():
    net = network(12, 8)
    texts = [np.array([(i + j) % 11 for j in range(40)] + [11]) for i in range(200)]
    before = net.scores(texts, 11).sum()
    for _ in range(12):
        net.learn_texts(texts, 11)
    assert net.scores(texts, 11).sum() > 0.6 * before


def test_shares_of_a_shared_symbol_sum_to_one():
    known = lm_score.Vocabulary([], np.zeros(0, np.int64), 3, 13, 5, np.array([10] + [0] * 63), np.array([3] + [0] * 63))
    assert known.unseen[0] == pytest.approx(3.5 / 11) and known.unseen[1] == 1.0
    assert (1 - known.unseen[0]) * 10 / 10 + known.unseen[0] == pytest.approx(1.0)


def test_frequent_words_are_told_apart():
    words = [f"w{i:04d}".encode() for i in range(1000)]
    known = lm_score.Vocabulary(words, np.arange(1000, 0, -1), 3, 13, 5, np.zeros(64, np.int64), np.zeros(64, np.int64))
    assert len(set(lm_score.Coder(known).all_symbols()[:447].tolist())) == 447


def test_words_of_one_step_beyond_the_dictionary_still_get_symbols(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "DICTIONARY", 50)
    monkeypatch.setattr(lm_score, "OWN", 40)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "a") for i in range(30)]
    counts = lm_score.word_counts(frame(spark, rows))
    known = lm_score.vocabulary(counts, len(rows))
    assert known.own == 40 and len(known.words) <= 50
    assert known.shared_total.sum() == 600 - 40 and known.total == 630


def test_runs_of_texts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(lm_score, "TEXT_BYTES", 100)
    texts = [b"x" * n for n in (10, 95, 400, 5, 5, 0, 90)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    runs = [r.column(0).to_pylist() for r in lm_score.text_runs([batch], "text")]
    assert [t for r in runs for t in r] == texts and all(sum(map(len, r)) < 100 + max(map(len, r)) for r in runs if any(r))
