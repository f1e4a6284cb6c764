"""Passages that repeat across documents, by sparse suffix arrays.

Words are what lies between ASCII white space, compared exactly.  A window of ``PASSAGE``
words is repeated if the same words occur elsewhere, in the same document or another; its
first occurrence (by document number, then text hash, then place) is the original, every
other a copy.  Copies of windows join up to passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from forecourt.llm.text import free_name, joined_by_key, quoted, row_key, slices, utf8_column
from forecourt.workspace import stored

PASSAGE = 50
#: Windows of positions of which one suffix is retained.  Any passage holds, among its first
#: ``SPAN`` positions, a retained one, and from there ``PASSAGE`` - ``SPAN`` + 1 more words.
SPAN = 26
#: Words whose hash decides which position of a span is retained.
SEED_WORDS = 8

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Suffixes:
    """Hashes of runs of words of one text, from running sums: any run in constant time."""

    def __init__(self, words: list[bytes], cache: dict[bytes, int], passage: int = PASSAGE, span: int = SPAN):
        self.n, self.passage, self.span = len(words), passage, span
        digest = xxhash.xxh64_intdigest
        if len(cache) > 500_000:
            cache.clear()
        hashes = np.empty(self.n, np.uint64)
        get = cache.get
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = cache[w] = digest(w)
            hashes[i] = h
        self._setup(hashes)

    def _setup(self, hashes: np.ndarray) -> None:
        powers = np.full(self.n + 1, np.uint64(_R))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * powers[:-1], out=self.sums[1:])
        inverse = np.full(self.n + 1, np.uint64(pow(_R, -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def runs(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from every position that has as many."""
        count = self.n - size + 1
        return _mix((self.sums[size:] - self.sums[:count]) * self.inverse[:count])

    def retained(self) -> np.ndarray:
        """For every passage-long window the position of its retained suffix."""
        windows = self.n - self.passage + 1
        if windows <= 0:
            return np.empty(0, np.int64)
        seeds = self.runs(SEED_WORDS)[: windows + self.span - 1]
        view = np.lib.stride_tricks.sliding_window_view(seeds, self.span)
        return np.arange(windows) + view.argmin(axis=1)


def packed(retained: np.ndarray) -> np.ndarray:
    """Each retained position once, with how many words before it its first window starts and how many windows it has.

    The windows that retain a position start one after another, so two numbers tell them all.
    """
    at, first, count = np.unique(retained, return_index=True, return_counts=True)
    return (at << 32) | ((at - first) << 16) | count


def unpacked(place: int) -> tuple[int, int, int]:
    return place >> 32, (place >> 16) & 0xFFFF, place & 0xFFFF


def _suffix_table(docs: DataFrame, passage: int, span: int) -> DataFrame:
    """``key``, ``_doc``, ``_hash``, ``place``: the retained suffixes by the hash of how they begin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in slices(batches, 256):
            found = []
            for row, text in enumerate(utf8_column(batch, "text")):
                if len(text) < 2 * passage - 1:
                    continue
                words = text.split()
                if len(words) < passage:
                    continue
                suffixes = Suffixes(words, cache, passage, span)
                places = packed(suffixes.retained())
                found.append((row, places, suffixes.runs(passage - span + 1)[places >> 32]))
            yield _rows(batch, found)

    return docs.mapInArrow(run, "key bigint, _doc bigint, _hash bigint, place bigint")


def _rows(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A batch of (key, document, hash, place) from what was found in each row."""
    names = ["key", "_doc", "_hash", "place"]
    if not found:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=names)
    take = pa.array(np.repeat([r for r, _, _ in found], [len(p) for _, p, _ in found]))
    keys = np.concatenate([k for _, _, k in found]).view(np.int64)
    places = np.concatenate([p for _, p, _ in found])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), batch.column(0).take(take), batch.column(1).take(take), pa.array(places)], names=names
    )


def _with_neighbour(suffixes: DataFrame) -> DataFrame:
    """The suffixes that begin like a neighbour in the order of hashes: all others are unique.

    Sorting is by range of (key, document, place), so a beginning that a third of all
    documents share is spread over tasks.  The first and last suffix of a task cannot see
    their neighbour in the next one and stay; the comparison of words decides later.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row seen, not yet decided
        same_before = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if held is not None:
                linked = held.column(0)[0].as_py() == keys[0]
                if linked or same_before:
                    yield held.select(["_doc", "_hash", "place"])
                same_before = linked
            equal = keys[1:] == keys[:-1]
            keep = np.zeros(len(keys), bool)
            keep[:-1] |= equal
            keep[1:] |= equal
            keep[0] |= same_before
            if len(keys) > 1:
                same_before = bool(equal[-1])
            held, body = batch.slice(len(keys) - 1), batch.slice(0, len(keys) - 1)
            yield body.filter(pa.array(keep[:-1])).select(["_doc", "_hash", "place"])
        if held is not None:
            yield held.select(["_doc", "_hash", "place"])

    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(parts, "key", "_doc", "_hash", "place").sortWithinPartitions("key", "_doc", "_hash", "place")
    return ordered.mapInArrow(run, "_doc bigint, _hash bigint, place bigint")


def _spelled(words: list[bytes]) -> list[bytes]:
    """Words as they are compared: those above 32 bytes by a hash of 128 bits, so that rows stay small."""
    if max(map(len, words)) <= 32:
        return words
    return [w if len(w) <= 32 else b"\0" + xxhash.xxh3_128_hexdigest(w).encode() for w in words]


def _contexts(docs: DataFrame, shared: DataFrame, passage: int) -> DataFrame:
    """``suffix``, ``before``, ``_doc``, ``_hash``, ``at``: retained suffixes with their words.

    ``suffix`` are the words from ``at`` on, as far as a window reaches that retains them, and
    ``before`` those in front, the nearest first, as far as one starts.  A space closes each.
    """
    per_doc = shared.groupBy("_doc", "_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))
    found = joined_by_key(docs, per_doc, "doc_id", "text", "inner").select(per_doc["_doc"], per_doc["_hash"], "text", "places")
    names = ["suffix", "before", "_doc", "_hash", "at"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows: list[tuple] = []
            doc, digest, places = (batch.column(batch.schema.get_field_index(c)) for c in ("_doc", "_hash", "places"))
            for row, text in enumerate(utf8_column(batch, "text")):
                words, key = _spelled(text.split()), (doc[row].as_py(), digest[row].as_py())
                for place in places[row].values.to_numpy().tolist():
                    at, back, count = unpacked(place)
                    suffix = b" ".join(words[at : at - back + count - 1 + passage]) + b" "
                    before = b"".join([w + b" " for w in reversed(words[at - back : at])])
                    rows.append((suffix, before, *key, at))
                    if len(rows) == 8192:
                        yield _batch(rows, names, _CONTEXT)
                        rows = []
            yield _batch(rows, names, _CONTEXT)

    return found.mapInArrow(run, "suffix binary, before binary, _doc bigint, _hash bigint, at int")


_CONTEXT = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
_VERDICT = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())


def _batch(rows: list[tuple], names: list[str], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def common_words(a: bytes, b: bytes) -> int:
    """How many words two sequences (a space behind each word) have in common at their start."""
    if a == b:
        return a.count(b" ")
    same = 0
    for x, y in zip(a.split(b" ")[:-1], b.split(b" ")[:-1]):
        if x != y:
            break
        same += 1
    return same


class Suffix:
    """A suffix with what stands before it, the first of those that agree in both (``many``: it is not alone)."""

    __slots__ = ("suffix", "before", "doc", "hash", "at", "many", "most", "least")

    def __init__(self, suffix: bytes, before: bytes, doc: int | None, digest: int, at: int, passage: int):
        self.suffix, self.before, self.doc, self.hash, self.at, self.many = suffix, before, doc, digest, at, False
        #: Its windows start ``least`` to ``most`` words before it.
        self.most, self.least = before.count(b" "), passage - suffix.count(b" ")

    @property
    def place(self) -> tuple:
        return self.doc is None, self.doc or 0, self.hash, self.at

    def span(self, most: int, least: int, original: bool) -> list[tuple]:
        """Verdict on the windows that start ``most`` to ``least`` words before."""
        if most < least:
            return []
        return [(None, self.doc, self.hash, self.at - most, most - least + 1, None, original)]

    def windows(self, passage: int) -> list[tuple]:
        """Its windows one by one, by a hash of their words, to be compared with all others."""
        before = self.before.split(b" ")[:-1][::-1]
        after = self.suffix.split(b" ")[:-1]
        words, found = before + after, []
        for start in range(self.most - self.least + 1):
            window = xxhash.xxh3_128_digest(b" ".join(words[start : start + passage]))
            found.append((window, self.doc, self.hash, self.at - self.most + start, 1, self.many, None))
        return found


class Neighbours:
    """Goes through suffixes in sorted order and says which of their windows occur elsewhere.

    Suffixes that begin alike (``passage - span + 1`` words) are a run.  One that agrees with
    its neighbour in all words its windows have is a later copy in all of them.  Of what
    then differs, two neighbours are extended to the right and left, word by word, and share
    the windows inside the match.  With three or more, neighbours in the order of the words
    behind need not be nearest in the words before (of ``L P x``, ``M P y``, ``L P z`` the outer
    two share ``L P``), so their windows are given out to be compared with one another.  So are
    those of the first and last run of a task, which may go on in the next one.
    """

    def __init__(self, passage: int, span: int):
        self.passage, self.begin = passage, passage - span + 1
        self.start: bytes | None = None
        self.first_run = True
        self.held: list[Suffix] = []
        self.crowded = False  # what is held has been given out already, or must be
        self.last: Suffix | None = None
        self.last_at: tuple | None = None

    def add(self, suffix: bytes, before: bytes, doc: int | None, digest: int, at: int) -> list[tuple]:
        last = self.last
        if last is not None and suffix == last.suffix and before == last.before:
            if (doc, digest, at) == self.last_at:
                return []  # the same document in another row
            self.last_at, last.many = (doc, digest, at), True
            return [(None, doc, digest, at - last.most, last.most - last.least + 1, None, False)]
        found = self._closed_class()
        if self.start is None or not suffix.startswith(self.start):
            found += self._closed_run(edge=False)
            self.start = b" ".join(suffix.split(b" ", self.begin)[: self.begin]) + b" "
        self.last, self.last_at = Suffix(suffix, before, doc, digest, at, self.passage), (doc, digest, at)
        return found

    def end(self) -> list[tuple]:
        return self._closed_class() + self._closed_run(edge=True)

    def _closed_class(self) -> list[tuple]:
        if self.last is None:
            return []
        self.held.append(self.last)
        self.last = None
        if len(self.held) > 2 or self.first_run or self.crowded:
            self.crowded = True
            return self._given_out()
        return []

    def _given_out(self) -> list[tuple]:
        found = [w for s in self.held for w in s.windows(self.passage)]
        self.held = []
        return found

    def _closed_run(self, edge: bool) -> list[tuple]:
        found: list[tuple] = []
        if edge:
            found = self._given_out()
        elif len(self.held) == 1 and self.held[0].many:
            found = self.held[0].span(self.held[0].most, self.held[0].least, True)
        elif len(self.held) == 2:
            found = self._extended(*self.held)
        self.first_run = self.start is None
        self.held, self.crowded = [], False
        return found

    def _extended(self, a: Suffix, b: Suffix) -> list[tuple]:
        left, right = common_words(a.before, b.before), common_words(a.suffix, b.suffix)
        found = []
        for s, other in ((a, b), (b, a)):
            most, least = min(left, s.most), max(self.passage - right, s.least)
            if most < least:
                most, least = s.least - 1, s.least  # nothing in common
            found += s.span(most, least, s.place < other.place)
            if s.many:  # outside the match it is the first of those that agree with it
                found += s.span(s.most, max(most + 1, s.least), True) + s.span(least - 1 if most >= least else s.least - 1, s.least, True)
        return found


def _judged(contexts: DataFrame, passage: int, span: int) -> DataFrame:
    """Verdicts by neighbours: ``_doc``, ``_hash``, ``at`` (first window), ``n`` windows, ``original``;
    or a ``window`` that is still to be compared, and whether ``many`` have it for sure.

    Suffixes are sorted by their words, then by those before, the document and the place, in
    ranges, so what a third of all documents share is spread over tasks.
    """
    order = ["suffix", "before", F.col("_doc").asc_nulls_last(), "_hash", "at"]
    names = ["window", "_doc", "_hash", "at", "n", "many", "original"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neighbours, rows = Neighbours(passage, span), []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                rows += neighbours.add(*row)
                if len(rows) >= 16_384:
                    yield _batch(rows, names, _VERDICT)
                    rows = []
        yield _batch(rows + neighbours.end(), names, _VERDICT)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "window binary, _doc bigint, _hash bigint, at int, n int, many boolean, original boolean")


def repeated_windows(docs: DataFrame, passage: int = PASSAGE, span: int = SPAN) -> DataFrame:
    """``_doc``, ``_hash``, ``at``, ``n``, ``original``: all windows that occur more than once, ``n`` from ``at`` on.

    ``docs`` has ``doc_id`` and ``text``.  Suffixes that begin like no other go first, by hash,
    so unique text costs one suffix in about ``span`` / 2 words.  The rest is sorted by words
    and neighbours are extended; windows that neighbours cannot decide are compared by minima
    combined in each task.  Rows that agree in number and text are one document.
    """
    keyed = docs.select(*row_key(), "text")
    suffixes = stored(_suffix_table(keyed, passage, span), "suffixes")
    shared = stored(_with_neighbour(suffixes), "shared_suffixes")
    contexts = stored(_contexts(docs, shared, passage), "suffix_words")
    judged = stored(_judged(contexts, passage, span), "judged_windows")
    decided = judged.filter("window IS NULL").select("_doc", "_hash", "at", "n", "original")
    rest = judged.filter("window IS NOT NULL")
    place = F.struct(F.col("_doc").isNull().alias("last"), F.col("_doc").alias("doc"), F.col("_hash").alias("hash"), F.col("at").alias("at"))
    first = rest.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("many").alias("sure"))
    first = first.filter("sure OR first <> last").select("window", "first")
    compared = rest.join(first, "window").select("_doc", "_hash", "at", "n", (F.col("first") == place).alias("original"))
    return decided.unionByName(compared)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, span: int = SPAN) -> DataFrame:
    """One row per repeated passage: ``_doc``, ``_hash``, ``start``, ``words``, ``original``.

    Windows of one kind (originals or copies) that touch or overlap are one passage.  NULL,
    empty and shorter texts have none; rows that agree in number and text share one row per
    passage; an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = repeated_windows(source, passage, span).withColumn("till", F.col("at") + F.col("n") - 1)
    places = found.groupBy("_doc", "_hash", "original").agg(F.sort_array(F.collect_set(F.struct("at", "till"))).alias("w"))
    # A passage begins where no window lies within reach before, and ends likewise.
    before = lambda i: F.get(F.col("w"), i - 1)["till"]
    after = lambda i: F.get(F.col("w"), i + 1)["at"]
    begins = F.transform("w", lambda p, i: F.when(before(i).isNull() | (p["at"] - before(i) > passage), p["at"]))
    ends = F.transform("w", lambda p, i: F.when(after(i).isNull() | (after(i) - p["till"] > passage), p["till"] + passage))
    zipped = F.arrays_zip(F.array_compact(begins).alias("start"), F.array_compact(ends).alias("stop"))
    spans = places.select("_doc", "_hash", "original", F.explode(zipped).alias("s"))
    return spans.select("_doc", "_hash", F.col("s.start").alias("start"), (F.col("s.stop") - F.col("s.start")).alias("words"), "original")


def cut_out(text: str, starts: list[int], sizes: list[int]) -> str:
    """``text`` without runs of words (from word ``start``, ``size`` words), each with the space behind it."""
    body = text.encode()
    words, at = body.split(), 0
    edges = np.empty((len(words) + 1, 1), np.int64)
    for i, w in enumerate(words):
        at = body.index(w, at)
        edges[i] = at
        at += len(w)
    edges[len(words)] = len(body)
    kept, last = [], 0
    for start, size in sorted(zip(starts, sizes)):
        kept.append(body[last : int(edges[start, 0])])
        last = int(edges[start + size, 0])
    kept.append(body[last:])
    return b"".join(kept).decode()


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with copies of passages cut out of their texts; originals stay.

    Documents left without a word by the cuts go.  All columns are kept, also those with dots in their names;
    ``n_chars``, if given, is set to the new length where a text was cut.  NULL, empty and
    short texts stay as they are; rows that agree in number and text are one document and are
    cut alike; an empty table gives no rows.
    """
    copies = passages(docs, doc_id, text).filter(~F.col("original"))
    name = free_name(docs, "_cuts")
    per_doc = copies.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("start", "words")).alias(name))
    joined = joined_by_key(docs, stored(per_doc, "cuts"), doc_id, text, "left")
    kept = joined.select(*[docs[quoted(c)] for c in docs.columns], F.col(name))
    whole = kept.filter(F.col(name).isNull()).drop(name)
    # Arrow batches take no names with dots in them, so columns go by their places.
    places = [f"c{i}" for i in range(len(docs.columns))]
    body = places[docs.columns.index(text)]
    found = kept.filter(F.col(name).isNotNull()).toDF(*places, "cuts")
    schema = found.select(*places, F.lit("").alias("rest")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
            cuts = batch.column(batch.schema.get_field_index("cuts")).to_pylist()
            made = [cut_out(t, [c["start"] for c in cs], [c["words"] for c in cs]) for t, cs in zip(texts, cuts)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in places]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string())], names=[*places, "rest"])

    cut = found.mapInArrow(run, schema).filter(F.col("rest").rlike(r"[^ \t-\r]"))
    columns = []
    for c, place in zip(docs.columns, places):
        value = F.col("rest") if c == text else F.col(place)
        if c == n_chars:
            value = F.length("rest").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return whole.unionByName(cut.select(*columns))
