"""Encoding and decoding against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import frame, odd_documents, table
from tokenizers import Tokenizer

from forecourt.llm import bpe, queries

FILE = queries.vocabulary("word_bpe_49k.json")
CODEC = bpe.codec(FILE)
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def test_query_agrees_with_the_library(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r for r in queries.op9_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = table("documents")
    assert len(rows) == len(texts)
    for t in texts:
        n, ids, decoded = expected(t["text"] or "")
        r = rows[t["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (n, sha(ids), sha(decoded))


def test_odd_rows_and_round_trip(spark):
    docs = frame(spark, odd_documents())
    encoded = bpe.encode_documents(docs, FILE)
    found = bpe.decode_documents(encoded, FILE).collect()
    assert len(found) == docs.count()
    for r in found:
        assert len(r["ids"]) == r["n_tokens"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.encode_documents(docs.limit(0), FILE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert next(iter(CODEC.encode([text]))) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst'.!?1é日<|>/w \n", max_size=80))
def test_texts_of_few_characters(text):
    assert next(iter(CODEC.encode([text]))) == expected(text)


def test_new_and_unassigned_characters():
    for text in (":\U0003d000", "a\u0558b", "\u0378\u0379 ½²x", "٣٤a", "\u00ad-\u200bz", ":\U00013460", "x\u1c89\u1c8a.", "1\U00010d40-"):
        assert next(iter(CODEC.encode([text]))) == expected(text)


def test_special_tokens_are_found_as_written():
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext|"):
        assert next(iter(CODEC.encode([text]))) == expected(text)


def test_compatible_pairs_are_those_that_merging_gives_back():
    rng = random.Random(7)
    inner = [i for t, i in CODEC.ids.items() if not t.endswith(bpe._END)]
    final = [i for t, i in CODEC.ids.items() if t.endswith(bpe._END)]
    first, second = np.array(rng.choices(inner, k=4000)), np.array(rng.choices(final, k=4000))
    back = {c: b for b, c in enumerate(CODEC.shown)}
    spelled = {i: t for t, i in CODEC.ids.items()}
    keep = []
    words = []
    for a, b in zip(first.tolist(), second.tolist()):
        raw = bytes(back[c] for c in (spelled[a] + spelled[b]).rstrip(bpe._END))
        try:
            words.append(raw.decode())
        except UnicodeDecodeError:
            keep.append(False)
            continue
        keep.append(True)
    keep = np.array(keep)
    fine = CODEC.compatible(first[keep], second[keep])
    exact = CODEC.merged(words)
    assert fine.tolist() == [e == [a, b] for e, a, b in zip(exact, first[keep].tolist(), second[keep].tolist())]


def test_failing_words_exist_and_are_merged_exactly():
    words = ["sttible", "thonre", "whthndre", "ententionthe"] + ["aaaaaaa", "hahahaha"]
    tokens, owner = CODEC.proposed(words)
    greedy = [tokens[owner == i].tolist() for i in range(len(words))]
    exact = CODEC.encoded_words(words)
    assert greedy != exact
    assert exact == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("limit", [1, 50])
def test_forgetting_changes_nothing(monkeypatch, limit):
    monkeypatch.setattr(bpe, "REMEMBERED", limit)
    texts = [r["text"] or "" for r in table("documents")][:20] + ["<|endoftext|> a"]
    assert [r for t in texts for r in CODEC.encode([t])] == [expected(t) for t in texts]
