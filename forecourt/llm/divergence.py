"""How the words of sources differ: counts by sorted word pointers, divergence of every pair of sources.

Words are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.  Each
language keeps the words that enough of its documents have; a source's share of a word is
smoothed by one and held in whole parts of ``SCALE``, so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.workspace import stored

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Bytes of text whose word pointers are sorted together.
SHARD_BYTES = 16 << 20
#: Pointers below which a slice is sorted at once instead of being partitioned again.
SMALL = 1 << 15
#: Sources side by side in one matrix of sums; pairs of more sources go by pairs of blocks.
BLOCK = 512
_PAIRS = 1 << 20
_MATRICES = 16

#: Byte by byte: A-Z lower-cased, other letters as they are, zero for all that is none.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256))
_MASKS = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(1, 9)], np.uint64)


# -- pointers ---------------------------------------------------------------------------


class Pointers:
    """Word starts in a buffer of lower-cased text."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        padded = np.concatenate([letters, np.zeros(16, np.uint8)])
        self.letters, self.starts, self.sizes = letters, starts, sizes
        self._words = np.ndarray((len(letters) + 8,), ">u8", padded, strides=(1,))

    @classmethod
    def of(cls, letters: np.ndarray, breaks: np.ndarray, is_letter: np.ndarray | None = None) -> Pointers:
        """Pointers to all runs of letters (by default bytes but zero); none reaches over a place in
        ``breaks`` (document starts)."""
        is_letter = letters != 0 if is_letter is None else is_letter
        begins = is_letter.copy()
        begins[1:] &= ~is_letter[:-1]
        inside = breaks[breaks < len(letters)]
        begins[inside] = is_letter[inside]
        ends = is_letter.copy()
        ends[:-1] &= ~is_letter[1:]
        before = inside[inside > 0] - 1
        ends[before] = is_letter[before]
        starts = np.flatnonzero(begins)
        return cls(letters, starts, np.flatnonzero(ends) + 1 - starts)

    def keys(self, which: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of each word from ``depth`` on as one number; zero behind its end."""
        at = np.minimum(self.starts[which] + depth, len(self.letters))
        left = np.clip(self.sizes[which] - depth, 0, 8)
        return self._words[at].astype(np.uint64) & _MASKS[left]

    def sort(self, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
        """Order of the pointers by word (equal words keep their order), and where words begin in it.

        Multikey quicksort over eight bytes at a time: a slice is parted into keys below,
        equal to and above a pivot; the equal part goes on eight bytes deeper, so a word
        that fills a third of the buffer is parted off at once.  Slices up to ``small`` are
        sorted as they are, and their runs of equal keys go on together.
        """
        order = np.arange(len(self.starts))
        first = np.zeros(len(order), bool)
        stack = [(0, self.keys(order, 0), 0)] if len(order) else []
        while stack:
            low, keys, depth = stack.pop()
            first[low] = True
            mine = order[low : low + len(keys)]
            if len(keys) <= small:
                self._finish(order, first, low, keys, depth)
                continue
            sample = np.sort(keys[:: max(1, len(keys) // 63)])
            pivot = sample[len(sample) // 2]
            below, equal = keys < pivot, keys == pivot
            above = ~(below | equal)
            n_below, n_equal = int(below.sum()), int(equal.sum())
            order[low : low + len(keys)] = np.concatenate([mine[below], mine[equal], mine[above]])
            if n_below:
                stack.append((low, keys[below], depth))
            if n_below + n_equal < len(keys):
                stack.append((low + n_below + n_equal, keys[above], depth))
            first[low + n_below] = True
            if pivot & np.uint64(0xFF):  # the words may go on
                same = order[low + n_below : low + n_below + n_equal]
                stack.append((low + n_below, self.keys(same, depth + 8), depth + 8))
        return order, first

    def _finish(self, order: np.ndarray, first: np.ndarray, low: int, keys: np.ndarray, depth: int) -> None:
        """Sort a small slice, then its runs of equal keys by what follows, all runs at a time."""
        at = np.arange(low, low + len(keys))
        run = np.zeros(len(keys), np.int64)
        while len(at):
            sort = np.lexsort((keys, run))
            order[at] = order[at][sort]
            keys, run = keys[sort], run[sort]
            begins = np.ones(len(at), bool)
            begins[1:] = (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])
            first[at] = begins
            alone = begins & np.append(begins[1:], True)
            more = ((keys & np.uint64(0xFF)) != 0) & ~alone
            at, run = at[more], np.cumsum(begins)[more]
            depth += 8
            keys = self.keys(order[at], depth)

    def word(self, which: int) -> bytes:
        return self.letters[self.starts[which] : self.starts[which] + self.sizes[which]].tobytes()

    def distinct(self, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """A number for every pointer, equal exactly for equal words of one ``kind``, from hashes of both."""
        _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[ids]
        unlike = (self.sizes != self.sizes[like]) | (kind != kind[like])
        live, depth = np.flatnonzero(~unlike), 0
        while len(live):
            unlike[live] = self.keys(live, depth) != self.keys(like[live], depth)
            depth += 8
            live = live[(self.sizes[live] > depth) & ~unlike[live]]
        named: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(unlike).tolist():  # two words with one hash
            ids[i] = named.setdefault((int(kind[i]), self.word(i)), len(first) + len(named))
        return ids

    def joined(self, which: np.ndarray, size: int) -> pa.Array:
        """The ``size`` words from each of ``which`` pointers as strings, one blank between words."""
        words = (which[:, None] + np.arange(size)).reshape(-1)
        last = np.arange(len(words)) % size == size - 1
        sizes = self.sizes[words] + ~last
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[words] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        out = self.letters[np.minimum(places, len(self.letters) - 1)]
        out[ends[~last] - 1] = 0x20
        offsets = np.append(0, ends[last]).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(out))


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _count_shard(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, docs, count) of the rows of one shard, by runs of equal sorted pointers."""
    langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    n_sources = len(sources.dictionary)
    group = np.asarray(langs.indices).astype(np.int64) * n_sources + np.asarray(sources.indices)
    text = batch.column(2).cast(pa.large_string())
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
    offsets = offsets - offsets[0]
    found = Pointers.of(np.frombuffer(raw.translate(_LETTERS), np.uint8), offsets[:-1])
    # Documents of one group side by side, so that a run of equal words is a run of groups too.
    by_group = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[by_group] = np.arange(len(group))
    ranks = rank[np.searchsorted(offsets, found.starts, side="right") - 1]
    arranged = np.argsort(ranks, kind="stable")
    found.starts, found.sizes, ranks = found.starts[arranged], found.sizes[arranged], ranks[arranged]
    order, first = found.sort()
    ranks = ranks[order]
    groups = group[by_group][ranks]
    new_group, new_doc = first.copy(), first.copy()
    new_group[1:] |= groups[1:] != groups[:-1]
    new_doc[1:] |= ranks[1:] != ranks[:-1]
    at = np.flatnonzero(new_group)
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(groups[at] // n_sources)),
            sources.dictionary.take(pa.array(groups[at] % n_sources)),
            found.joined(order[at], 1),
            pa.array(docs),
            pa.array(np.diff(np.append(at, len(order)))),
        ],
        names=["lang", "source", "term", "docs", "count"],
    )


def term_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang``, ``source``, ``term``, ``docs``, ``count`` over ``docs`` (``lang``, ``source``, ``text``, no NULL).

    Each task sorts pointers to the words of one shard of its texts after another, in the
    Arrow buffers; runs of equal words give the rows of the shard, which are then summed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in byte_slices(batch, 2, shard_bytes):
                rows = _count_shard(shard)
                for start in range(0, rows.num_rows, 50_000):
                    yield rows.slice(start, 50_000)

    rows = docs.select("lang", "source", "text").mapInArrow(
        run, "lang string, source string, term string, docs bigint, count bigint"
    )
    return rows.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


# -- divergence -------------------------------------------------------------------------


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), whatever the size of the counts; 1 without a total."""
    scaled = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(total > 0, 1 + F.call_function("div", scaled, total.cast("decimal(20,0)"))).otherwise(F.lit(1).cast("bigint"))


def unlikeness(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _unlike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts of words in at least ``min_docs`` documents of their language; ``whole`` is the language's
    count, ``leads`` true on one row of each word."""
    word = Window.partitionBy("lang", "term")
    seen = counts.select(
        "lang", "source", "term", "count",
        F.sum("docs").over(word).alias("docs"),
        F.sum("count").over(word).alias("whole"),
        (F.min("source").over(word) == F.col("source")).alias("leads"),
    )
    return seen.filter(F.col("docs") >= min_docs).drop("docs")


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per language and source: ``n`` kept words, ``v`` and ``whole_n`` of the language, place ``ix``, share ``p0`` of an absent word."""
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.when(F.col("leads"), 1)).alias("led"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("led", F.lit(0)).alias("led"))
    lang = Window.partitionBy("lang")
    return groups.select(
        "lang", "source", "n",
        F.sum("led").over(lang).alias("v"),
        F.sum("n").over(lang).alias("whole_n"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("ix"),
    ).withColumn("p0", share(F.lit(0), F.col("n") + F.col("v")))


def _shared_words(entries: DataFrame, block: int) -> DataFrame:
    """``lang``, ``a``, ``b`` (places of two sources), ``value``: what the words that both have add to the
    sum over words counted as if the other source had none of them.

    Entries of a word meet within a block of sources, or two blocks: at most twice ``block``
    in a list.  Their pairs are never rows: a task adds them up in a matrix per two blocks.
    """
    row_type = "lang string, a bigint, b bigint, value bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, low, high), matrix in sums.items():
                a, b = np.nonzero(matrix)
                fields = [pa.array([lang] * len(a), pa.string()), pa.array(a + low * block), pa.array(b + high * block), pa.array(matrix[a, b])]
                yield pa.RecordBatch.from_arrays(fields, names=["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            low, high = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            code = np.asarray(langs.indices).astype(np.int64)
            kinds, kind = np.unique(np.stack([code, low, high]), axis=1, return_inverse=True)
            for k in range(kinds.shape[1]):
                key = (langs.dictionary[int(kinds[0, k])].as_py(), int(kinds[1, k]), int(kinds[2, k]))
                if key not in sums:
                    if len(sums) >= _MATRICES:
                        yield from rows()
                    sums[key] = np.zeros((block, block), np.int64)
                words = batch.column(3).filter(pa.array(kind.ravel() == k))
                _add_pairs(sums[key], words, key[1] * block, key[2] * block)
        yield from rows()

    last = F.floor((F.col("sources") - 1) / block).cast("int")
    others = F.sequence(F.lit(0), last)
    own = F.floor(F.col("ix") / block).cast("int")
    meetings = F.array_distinct(
        F.concat(
            F.transform(others, lambda o: F.struct(own.alias("low"), o.alias("high"))),
            F.transform(others, lambda o: F.struct(o.alias("low"), own.alias("high"))),
        )
    )
    dealt = entries.select("lang", "term", F.struct("ix", "p", "p0").alias("entry"), F.explode(meetings).alias("m"))
    words = dealt.groupBy("lang", "m.low", "m.high", "term").agg(F.collect_list("entry").alias("entries"))
    return words.filter(F.size("entries") > 1).select("lang", "low", "high", "entries").mapInArrow(run, row_type)


def _add_pairs(sums: np.ndarray, words: pa.ListArray, low: int, high: int) -> None:
    """Add the pairs of every word: the first from the block of sources at ``low``, the second at ``high``."""
    sizes = np.asarray(pc.list_value_length(words)).astype(np.int64)
    entries = words.flatten()
    ix, p, p0 = (np.asarray(f).astype(np.int64) for f in entries.flatten())
    block = len(sums)
    # Each entry meets all of its word, in pieces of bounded numbers of pairs.
    width = np.repeat(sizes, sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = np.cumsum(width) // _PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(ix)]
    for start, stop in zip(cuts, cuts[1:]):
        w = width[start:stop]
        left = np.repeat(np.arange(start, stop), w)
        right = np.arange(len(left)) + np.repeat(begin[start:stop] - (np.cumsum(w) - w), w)
        a, b = ix[left] - low, ix[right] - high
        wanted = (ix[left] != ix[right]) & (a >= 0) & (a < block) & (b >= 0) & (b < block)
        left, right = left[wanted], right[wanted]
        value = _unlike(p[left], p[right]) - _unlike(p[left], p0[right]) - _unlike(p0[left], p[right]) + _unlike(p0[left], p0[right])
        np.add.at(sums.reshape(-1), a[wanted] * block + b[wanted], value)


def pair_sums(entries: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: unlikeness of each two sources over all kept words.

    A word that neither has adds a constant, so their number is enough.  What a word adds
    that only one has depends on its count alone, so counts of counts are enough.  Only
    words that both have are looked at one by one.
    """
    mine = groups.select("lang", "source", "ix", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("ix").alias("item_ix"), F.col("p0").alias("q0"))
    wide = lambda c: c.cast("decimal(38,0)")
    pairs = mine.join(other, "lang").filter("source <> item")
    absent = pairs.select("lang", "ix", "item_ix", wide(F.col("v") * unlikeness(F.col("p0"), F.col("q0"))).alias("value"))
    steps = entries.groupBy("lang", "ix", "p", "p0").agg(F.count("*").alias("words"))
    met = steps.join(other, "lang").filter("ix <> item_ix")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    one = F.explode(
        F.array(
            F.struct(F.col("ix").alias("a"), F.col("item_ix").alias("b"), (unlikeness(p, q0) - unlikeness(p0, q0)).alias("d")),
            F.struct(F.col("item_ix").alias("a"), F.col("ix").alias("b"), (unlikeness(q0, p) - unlikeness(q0, p0)).alias("d")),
        )
    )
    alone = met.select("lang", "words", one.alias("o")).select("lang", "o.a", "o.b", (wide(F.col("words")) * wide(F.col("o.d"))).cast("decimal(38,0)").alias("value"))
    both = _shared_words(entries, block).select("lang", "a", "b", wide(F.col("value")).alias("value"))
    sums = absent.toDF("lang", "a", "b", "value").unionByName(alone).unionByName(both)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").cast("bigint").alias("value"))
    left = groups.select("lang", "source", F.col("ix").alias("a"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("ix").alias("b"))
    return sums.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", "source", "item", "value")


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    block: int = BLOCK,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``, ``count`` and ``share``.

    Part ``pair``: unlikeness of the source to every other of its language over all words
    kept.  Part ``term``: the ``top`` words the source has more of than its language, with
    their count there and share (in parts of ``SCALE``).  Ties go by the item's UTF-8 bytes.
    NULL in any column reads as ''; each row is a document of its own, repeated rows too;
    a source without words has shares as if its counts were zero, and a language without
    kept words gives zeros; a lone source has no pairs; an empty table gives no rows; other
    columns are not read.
    """
    empty = F.lit("")
    read = docs.select(
        *[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    kept = stored(kept_counts(term_counts(read), min_docs), "kept_words")
    groups = stored(source_groups(read, kept), "source_groups")
    lang_size = Window.partitionBy("lang")
    places = groups.withColumn("sources", F.count("*").over(lang_size))
    entries = kept.join(places, ["lang", "source"]).select(
        "lang", "source", "term", "count", "ix", "sources", "p0",
        share(F.col("count"), F.col("n") + F.col("v")).alias("p"),
        share(F.col("whole"), F.col("whole_n") + F.col("v")).alias("q"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best).alias("rank")
    pair = pair_sums(entries, groups, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    more = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), unlikeness(F.col("p"), F.col("q")).alias("value"), "count", "p")
    term = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank, "count", F.col("p").alias("share")).filter(F.col("rank") <= top)
    none = F.lit(None).cast("bigint")
    return pair.withColumns({"count": none, "share": none}).unionByName(term)
