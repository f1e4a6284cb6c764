"""Packing: every token once, in place, in few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import frame, odd_documents, table
from tokenizers import Tokenizer

from forecourt.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, length=1024):
    """Raise unless ``rows`` are the pieces of ``texts`` (id -> texts), packed without gaps."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    expected = defaultdict(list)
    for doc, bodies in texts.items():
        for body in bodies:
            ids = TOKENIZER.encode(body or "", add_special_tokens=False).ids + [2]
            first = len(ids) % length or length if len(ids) > length else len(ids)
            starts = [0, *range(first, len(ids), length)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                expected[doc].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for d, rs in pieces.items()}
    assert got == {d: sorted(e) for d, e in expected.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= length
    return len(bins), -(-sum(r["length"] for r in rows) // length)


def test_query_packs_every_token(spark):
    rows = queries.op2_packing(spark, "/root/testdata/sf0.001").collect()
    used, least = check(rows, {r["doc_id"]: [r["text"]] for r in table("documents")})
    assert used <= least + 3


def test_odd_rows(spark):
    docs = frame(spark, odd_documents())
    texts = defaultdict(list)
    for doc, text, _ in odd_documents():
        texts[doc].append(text)
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    check(packing.pack_documents(docs, vocabulary, public_tokenizers.PATTERN).collect(), texts)
    assert packing.pack_documents(docs.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0


def items_of(spark, lengths):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@pytest.mark.parametrize("task_pieces", [50, 400, 10_000])
def test_rounds_merge_underfull_bins(spark, task_pieces):
    rng = random.Random(4)
    lengths = [rng.choice([rng.randrange(1, 300), rng.randrange(300, 1025)]) for _ in range(3000)]
    rows = packing.packed(items_of(spark, lengths), task_pieces=task_pieces).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(found)])]
        assert [o for o, _ in sorted(found)] == [int(e) for e in ends[:-1]] and ends[-1] <= 1024
    whole = packing.best_fit(np.array(lengths), 1024)[0].max() + 1
    assert len(bins) <= (1.03 if task_pieces < 100 else 1.02) * whole + 1


def test_items_that_cannot_share_stop_the_rounds(spark):
    rows = packing.packed(items_of(spark, [600] * 500), task_pieces=20).collect()
    assert len({r["sequence_id"] for r in rows}) == 500


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([600, 500, 424, 400, 100]), 1024)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 600, 500, 900]


@pytest.mark.parametrize("total", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_only_the_first_piece_is_short(total):
    pieces = packing.cut(np.zeros(total), 1024)
    assert sum(n for _, n in pieces) == total
    assert all(n == 1024 for _, n in pieces[1:])
    assert len(pieces) == -(-total // 1024)


@pytest.mark.parametrize("gap", [" ", "\t", "\n"])
def test_long_runs_of_white_space_have_the_tokenizers_ids(gap):
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    coder = packing.encoding(vocabulary, public_tokenizers.PATTERN)
    text = "x" + gap * 2_000_000 + "y <|endoftext|>"
    ids = packing.token_ids(coder, vocabulary, text)
    assert packing.tokenizer(vocabulary).decode(ids.tolist(), skip_special_tokens=False) == text
    assert packing.token_ids(coder, vocabulary, "a  b\n\n c").tolist() == packing.tokenizer(vocabulary).encode("a  b\n\n c", add_special_tokens=False).ids
