"""Encoding with a byte-pair vocabulary by speculation and verification, and decoding.

Greedy longest matches propose the tokens of a word.  A proposal is what merging in order of
rank would give exactly if every two neighbours are compatible: if merging what the two
spell gives these two back.  All pairs of a batch are tested at once; only words with a
failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from forecourt.llm.packing import byte_alphabet
from forecourt.llm.text import slices

#: Chunks of text (between white space) whose tokens a worker remembers.
REMEMBERED = 600_000
_END = "\0"  # stands for the end of a word; no byte is shown by it
_LATE = np.int64(1) << np.int64(60)  # after any merge


class Codec:
    """A lower-casing byte-level BPE with word ends, as its tokenizer file describes it."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.shown = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]
        own = lambda t: t[: -len(self.suffix)] + _END if t.endswith(self.suffix) and len(t) > len(self.suffix) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        size = max(model["vocab"].values()) + 1
        # How each token is made: left and right part, and the rank of that merge.
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.made = np.empty(len(model["merges"]), np.int64)
        keys = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = self.ids[own(a)], self.ids[own(b)], self.ids[own(a + b)]
            self.made[rank] = made
            self.left[made], self.right[made], self.rank[made] = x, y, rank
            keys.append(x << 32 | y)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = np.array(keys)[self.pair_ranks]
        self.inner = np.array([self.ids[c] for c in self.shown])
        self.final = np.array([self.ids[c + _END] for c in self.shown])
        self._trie()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.library = Tokenizer.from_str(file)
        self.classes = {c: pre_tokenizers.Split(Regex(rf"\p{{{c}}}"), "isolated") for c in "LN"}
        self.specials_in = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.numbers = {i: str(i) for i in self.tokens}
        self.known: dict[str | int, tuple[int, str, str]] = {i: (1, str(i), t) for t, i in self.special.items()}

    # -- words --------------------------------------------------------------------------

    def _trie(self) -> None:
        """Tokens as paths of bytes: sorted (node, byte) edges and the token that ends at a node.

        The bytes of a word are followed by 256, the sign of its end.
        """
        value = {c: b for b, c in enumerate(self.shown)} | {_END: 256}
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for token, i in self.ids.items():
            node = 0
            for c in token:
                edge = (node, value[c])
                if edge not in nodes:
                    nodes[edge] = len(ends)
                    ends.append(-1)
                node = nodes[edge]
            ends[node] = i
        keys = np.array([a * 512 + b for a, b in nodes])
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(nodes.values()))[order]
        self.ends = np.array(ends)

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens, and the word that each belongs to.

        All places of all words walk down the trie together, which gives the longest token
        at every place; then all words hop from token to token together.  The sign of the
        end belongs to the last byte, so no token may stop between the two.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        starts = np.cumsum(sizes) - sizes
        symbols = np.full(int(sizes.sum()), 256, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[starts + sizes - 1] = False
        symbols[inner] = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), sizes)
        token, length = np.full(len(symbols), -1), np.zeros(len(symbols), np.int64)
        place, node, depth = np.flatnonzero(inner), np.zeros(int(inner.sum()), np.int64), 0
        while len(place):
            key = node * 512 + symbols[place + depth]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            on = self.edge_keys[at] == key
            place, node = place[on], self.edge_to[at[on]]
            depth += 1
            ending = self.ends[node]
            # The next symbol of a word's last byte is the sign of its end.
            stop = place + depth
            whole = (ending >= 0) & ((symbols[stop - 1] == 256) | (symbols[np.minimum(stop, len(symbols) - 1)] != 256))
            token[place[whole]], length[place[whole]] = ending[whole], depth
            going = symbols[stop - 1] != 256
            place, node = place[going], node[going]
        at, owner, tokens, owners, places = starts, np.arange(len(raw)), [], [], []
        while len(at):
            tokens.append(token[at])
            owners.append(owner)
            places.append(at)
            at = at + length[at]
            going = at < (starts + sizes)[owner]
            at, owner = at[going], owner[going]
        if not tokens:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(np.concatenate(places), kind="stable")
        return np.concatenate(tokens)[order], np.concatenate(owners)[order]

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact merging: in every word its pair of least rank, leftmost first, until none is left.

        All words go together; a merge makes no pair of lower rank, so all places of a
        word's best pair are merged in one step.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[list[int]] = [[] for _ in raw]
        while len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(word), _LATE)
            rank[:-1] = np.where(word[1:] == word[:-1], self.ranks(symbols[:-1], symbols[1:]), _LATE)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            ready = best == _LATE
            if ready.any():
                at, owner = symbols[ready], word[ready]
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]).tolist()
                listed = at.tolist()
                for a, b in zip(cuts, cuts[1:]):
                    done[owner[a]] = listed[a:b]
                symbols, word, rank, best = symbols[~ready], word[~ready], rank[~ready], best[~ready]
                if not len(word):
                    break
            hit = rank == best
            # In a run of overlapping hits every second one is merged, from the left.
            place = np.arange(len(hit))
            begin = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(begin, place, -1))
            chosen = hit & ((place - run) % 2 == 0)
            symbols[chosen] = self.made[rank[chosen]]
            stay = ~np.r_[False, chosen[:-1]]
            symbols, word = symbols[stay], word[stay]
        return done

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, ``_LATE`` where there is none."""
        key = first << 32 | second
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _LATE)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether merging what they spell together gives them back.

        Before a token is complete, its part at the border takes its place.  Going back in
        time from the finished pair, at each moment one part of either side meets at the
        border; a merge of the two that comes before either would be taken up into its own
        token breaks the pair.  All pairs go back together, one step at a time.
        """
        u, v = first.copy(), second.copy()
        until_u, until_v = np.full(len(u), _LATE), np.full(len(v), _LATE)
        fine = np.ones(len(u), bool)
        live = np.arange(len(u))
        while len(live):
            rank = self.ranks(u[live], v[live])
            # Of equal merges the left one goes first: it may cross the border only if it
            # comes before the one on the left, and not after the one on the right.
            broken = (rank < until_u[live]) & (rank <= until_v[live]) & (rank < _LATE)
            fine[live[broken]] = False
            live = live[~broken]
            ru, rv = self.rank[u[live]], self.rank[v[live]]
            more = (ru >= 0) | (rv >= 0)
            live, ru, rv = live[more], ru[more], rv[more]
            left_side = ru > rv
            a, b = live[left_side], live[~left_side]
            until_u[a], u[a] = self.rank[u[a]], self.right[u[a]]
            until_v[b], v[b] = self.rank[v[b]], self.left[v[b]]
        return fine

    def encoded_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of every word: proposals, checked together, exact where a pair fails."""
        if not words:
            return []
        flat, word = self.proposed(words)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back] if len(pairs) else np.ones(0, bool)
        cuts = [0, *(np.flatnonzero(word[1:] != word[:-1]) + 1).tolist(), len(flat)]
        listed = flat.tolist()
        tokens = [listed[a:b] for a, b in zip(cuts, cuts[1:])]
        failing = np.unique(word[inside[~fine]]).tolist()
        for w, exact in zip(failing, self.merged([words[w] for w in failing])):
            tokens[w] = exact
        return tokens

    # -- texts --------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """Composed, lower-cased character by character, as the file's normaliser does."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """What lies between white space; no token crosses it.

        ``str.split`` also cuts at four control characters that are no white space here.
        """
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.findall(r"\S+", text)
        return text.split()

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk by the file's pattern.

        Beyond ASCII each character is matched by way of one that stands for its class, from
        ``unicodedata``.  Characters that are unassigned there may be newer letters or
        numbers: the tokenizer library knows their class and lower case.
        """
        if chunk.isascii():
            return self.pattern.findall(chunk)
        if any(category(c) == "Cn" for c in chunk):
            chunk = self.library.normalizer.normalize_str(chunk)
        shape = "".join([c if c.isascii() else self.stand_in(c) for c in chunk])
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(shape)]

    def stand_in(self, c: str) -> str:
        """A letter, a number or a symbol in place of a character of that class."""
        kind = category(c)
        if kind == "Cn":
            for name, split in self.classes.items():
                if len(split.pre_tokenize_str("\1" + c)) > 1:
                    kind = name
        return {"L": "Z", "N": "0"}.get(kind[0], "\1")

    def learn(self, fresh: list[str]) -> None:
        """Remember the tokens of chunks: how many, their ids and their texts, as strings."""
        words = [[c] if c.isalpha() else self.words_of(c) for c in fresh]
        distinct = list({w for ws in words for w in ws})
        shown, numbers = self.tokens.__getitem__, self.numbers.__getitem__
        by_word = {
            w: (len(ids), " ".join(map(numbers, ids)), " ".join(map(shown, ids)))
            for w, ids in zip(distinct, self.encoded_words(distinct))
        }
        known = self.known
        for chunk, ws in zip(fresh, words):
            if len(ws) == 1:
                known[chunk] = by_word[ws[0]]
            else:
                sizes, ids, texts = zip(*[by_word[w] for w in ws]) if ws else ((), (), ())
                known[chunk] = (sum(sizes), " ".join(ids), " ".join(texts))

    def decoded(self, ids: Iterable[int]) -> str:
        """Texts of tokens, joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def parts(self, text: str) -> list[str | int]:
        """Chunks of a text in order, and ids of special tokens written out in it."""
        if self.specials_in is None or not any(s in text for s in self.special):
            return self.chunks(self.normal(text))
        found: list[str | int] = []
        for piece in self.specials_in(text):
            found += [self.special[piece]] if piece in self.special else self.chunks(self.normal(piece))
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: the number of tokens, their ids and their decoded text, both joined by spaces."""
        parts = [self.parts(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known.update({i: (1, str(i), s) for s, i in self.special.items()})
        self.learn([p for p in set().union(*parts) - known.keys()])
        for ps in parts:
            if not ps:
                yield 0, "", ""
                continue
            sizes, ids, texts_ = zip(*map(known.__getitem__, ps))
            # A chunk without a token (none is known) would leave a double space.
            if 0 in sizes:
                ids, texts_ = filter(None, ids), filter(None, texts_)
            yield sum(sizes), " ".join(ids), " ".join(texts_)


@lru_cache(maxsize=2)
def codec(file: str) -> Codec:
    return Codec(file)


def _text_batches(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` if wanted, of every row.

    ``file`` is the text of the tokenizer file and goes to the tasks as a broadcast of its
    size.  Texts are read whole; a worker remembers a bounded number of chunks.  NULL and
    empty texts have no tokens; repeated rows each get a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(file)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for some in _text_batches(texts):
                for n, numbers, shown in coder.encode(some):
                    rows.append((n, sha(numbers), sha(shown), *([[int(x) for x in numbers.split()]] if ids else [])))
            columns = [batch.column(0), *map(pa.array, zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, file: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token ids; NULL ids give NULL."""
    sent = encoded.sparkSession.sparkContext.broadcast(file)
    schema = encoded.select("*", F.lit("").alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value)
        for batch in slices(batches, 512):
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else coder.decoded(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, schema)
