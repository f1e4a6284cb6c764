"""Phrases whose words go together, found by Toivonen's sampling.

Texts are cut into pieces at punctuation and line ends, pieces into words at blanks.  A
sample of the documents proposes frequent phrases; a pass over all texts counts these and
their negative border exactly; as long as a border phrase turns out frequent, a further pass
counts what it opens.  What is frequent then is complete, whatever the sample was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.llm.divergence import Pointers, byte_slices
from forecourt.workspace import stored

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: One document in so many is in the sample, by hash.
SAMPLE = 4
#: A phrase is proposed from this share of the count it would have in the sample at the bound.
LOWERED = 0.6
#: A candidate goes if a longer one around it has this share of its count (in hundredths).
COVERED = 80
SCORE_SCALE = 2_000_000
UNKNOWN_LANG = "und"
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 3 << 20
#: Largest sieve, in 64-bit cells (32 MB): a proven bound on what is sent to the tasks.
MAX_CELLS = 1 << 22

#: Byte by byte: A-Z lower-cased; and 2 for ends of pieces, 1 for blanks, 0 for what words are made of.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_KINDS = bytes(2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_SIZE = np.uint64(3)
_LONG = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Sieve:
    """A set of 64-bit keys of bounded size: every key put in passes, few others do.

    Others that pass only cost counting: results never depend on them.
    """

    _STEPS = (0, 6)  # where the places of a key's bits within its cell are read from it

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.shift = np.uint64(64 - (len(cells).bit_length() - 1))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        cells = self.cells[(keys >> self.shift).astype(np.int64)]
        last = np.uint64(63)
        found = np.ones(len(keys), np.uint64)
        for step in self._STEPS:
            found &= cells >> ((keys >> np.uint64(step + 2)) & last)
        return found.astype(bool)

    @classmethod
    def of(cls, keys: DataFrame, max_cells: int = MAX_CELLS) -> Sieve:
        """Sieve of a table's ``key`` (bigint); at most ``max_cells`` rows reach the driver."""
        n = keys.count()
        bits = min(max(12, (n // 4).bit_length()), max_cells.bit_length() - 1)
        key = F.col("key")
        mask = F.lit(0).cast("bigint")
        for step in cls._STEPS:
            at = F.shiftrightunsigned(key, step + 2).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
        cell = F.shiftrightunsigned(key, 64 - bits).alias("cell")
        found = keys.groupBy(cell).agg(F.bit_or(mask).alias("mask")).toArrow()
        cells = np.zeros(1 << bits, np.uint64)
        cells[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        return cls(cells)


class Slice:
    """Words of some rows (``lang``, ``text``): where they begin, which follow one another, their keys."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        text = batch.column(1).cast(pa.large_string())
        _, ends, data = text.buffers()
        offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
        raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
        offsets = offsets - offsets[0]
        kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
        self.found = Pointers.of(np.frombuffer(raw.translate(_LOWER), np.uint8), offsets[:-1], kinds == 0)
        starts = self.found.starts
        doc = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(kinds == 2), starts)
        #: Word i + 1 is in the same piece as word i.
        self.follows = np.zeros(len(starts), bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.lang = np.asarray(langs.indices).astype(np.int64)[doc] if len(starts) else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(x.as_py().encode()) for x in self.langs], np.uint64)
        #: Key of each word: of its bytes and language, and (in the last two bits) of the words in a phrase.
        self.keys = _mix(self._hashes() ^ seeds[self.lang]) & ~_SIZE if len(starts) else np.zeros(0, np.uint64)

    def _hashes(self) -> np.ndarray:
        """64-bit hash of every word, eight bytes at a time; of very long words at once."""
        sizes = self.found.sizes
        out = sizes.astype(np.uint64) * _A
        live = np.flatnonzero(sizes <= _LONG)
        depth = 0
        while len(live):
            out[live] = _mix(out[live] * _A ^ self.found.keys(live, depth))
            depth += 8
            live = live[sizes[live] > depth]
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.found.word(i))
        return out

    def longer(self, at: np.ndarray, keys: np.ndarray, parts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the phrases of ``size`` words both of whose shorter parts are marked in
        ``parts``; ``at`` and ``keys`` are all the shorter ones."""
        whole = np.zeros(len(self.keys), np.uint64)
        whole[at] = keys
        places = np.flatnonzero(parts[:-1] & parts[1:] & self.follows[: len(parts) - 1])
        return places, _mix(whole[places] * _A + self.keys[places + size - 1]) & ~_SIZE | np.uint64(size - 1)

    def levels(self, sieve: Sieve | None, known: int = MAX_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to ``MAX_WORDS`` words: places and keys of the phrases whose two parts, one word
        shorter, pass the sieve, and which pass themselves.  The sieve is not asked about phrases
        of more than ``known`` words: they pass."""
        at, keys = np.arange(len(self.keys)), self.keys
        for size in range(1, MAX_WORDS + 1):
            if size > 1:
                parts = np.zeros(len(self.keys) + 1, bool)
                parts[at] = passed
                at, keys = self.longer(at, keys, parts, size)
            passed = sieve.passes(keys) if sieve is not None and size <= known else np.ones(len(at), bool)
            yield at, keys, passed

    def opened(self, sieve: Sieve, failures: Sieve, words: Sieve) -> Iterator[np.ndarray]:
        """For 2 to ``MAX_WORDS`` words: keys of the phrases that ``sieve`` kept from being counted, that hold a
        phrase of ``failures`` inside and whose words are all in ``words``."""
        frequent = words.passes(self.keys)
        at, keys = np.arange(len(self.keys)), self.keys
        usable, hold = np.append(frequent, False), np.zeros(len(self.keys) + 1, bool)
        for size, (counted, old, _) in enumerate(self.levels(sieve), 1):
            if size > 1:
                at, keys = self.longer(at, keys, usable, size)
                usable = np.zeros(len(self.keys) + 1, bool)
                usable[at] = True
                inside = hold[:-1] | hold[1:]
                new = inside.copy()
                new[counted] = False
                yield keys[new[at]]
                hold = np.append(inside & usable[:-1], False)
            hold[counted] |= failures.passes(old)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for part in byte_slices(batch, 1, SLICE_BYTES):
            yield Slice(part)


def _summed(texts: DataFrame, keys_of, least: int) -> DataFrame:
    """``key``, ``f``: counts, of ``least`` or more, of the keys that ``keys_of`` names in each slice of the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            for keys in keys_of(words):
                key, often = np.unique(keys, return_counts=True)
                for a in range(0, len(key), 50_000):
                    some = [pa.array(key[a : a + 50_000].view(np.int64)), pa.array(often[a : a + 50_000].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(some, names=["key", "f"])

    rows = texts.select("lang", "text").mapInArrow(run, "key bigint, f bigint")
    return rows.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _counted(texts: DataFrame, least: int, sizes: range, sieve: Sieve | None, known: int = MAX_WORDS) -> DataFrame:
    """Counts of the phrases of ``sizes`` words whose two parts, one word shorter, pass the sieve."""
    sent = texts.sparkSession.sparkContext.broadcast(sieve)

    def keys_of(words: Slice) -> Iterator[np.ndarray]:
        for size, (_, keys, _) in enumerate(words.levels(sent.value, known), 1):
            if size in sizes:
                yield keys
            if size == sizes[-1]:
                return

    return _summed(texts, keys_of, least)


def _proposed(texts: DataFrame, sample: Column, share: float, min_count: int) -> Sieve:
    """Sieve of the phrases that are frequent in the sample, by a lowered bound."""
    some = texts.filter(sample)
    least = max(1, int(min_count * share * LOWERED))
    words = stored(_counted(some, least, range(1, 2), None), "sample_words")
    pairs = stored(_counted(some, least, range(2, 3), Sieve.of(words), 1), "sample_pairs")
    found = words.unionByName(pairs)
    longer = stored(_counted(some, least, range(3, MAX_WORDS + 1), Sieve.of(found), 2), "sample_longer")
    return Sieve.of(found.unionByName(longer))


def frequent_keys(texts: DataFrame, sample: Column, share: float, min_count: int = MIN_COUNT) -> DataFrame:
    """Keys (``key``, ``f``) that include every phrase with ``min_count`` occurrences.

    ``texts`` has ``lang`` and ``text`` and what ``sample`` reads.  The full pass counts all words
    and every phrase whose two parts the sample proposed: proposals and their negative border.
    A frequent phrase that was not proposed is a failure: what holds it was not counted.  If
    there are any, one more pass counts, of all sizes, what holds a failure and consists of
    frequent words.  Then all is closed: a frequent phrase not counted before holds a smallest
    part that was not proposed, and that part is in the border, frequent, so a failure.
    """
    sieve = _proposed(texts, sample, share, min_count)
    context = texts.sparkSession.sparkContext
    found = stored(_counted(texts, min_count, range(1, MAX_WORDS + 1), sieve), "frequent")
    first = context.broadcast(sieve)

    def missed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes = first.value.passes(np.asarray(batch.column(0)).view(np.uint64))
            yield batch.filter(pa.array(~passes))

    size = F.col("key").bitwiseAND(F.lit(3)) + 1
    failures = stored(found.filter(size < MAX_WORDS).mapInArrow(missed, found.schema), "failures")
    if failures.isEmpty():
        return found
    others = context.broadcast((Sieve.of(failures), Sieve.of(found.filter(size == 1))))
    more = _summed(texts, lambda words: words.opened(first.value, *others.value), min_count)
    return found.unionByName(stored(more, "opened"))


def phrase_counts(texts: DataFrame, keys: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``f``: exact counts, by the words themselves, of phrases with ``min_count``
    occurrences; and of each language ``phrase`` '' with the count of all its words.

    ``keys`` only say what to look at: a key that two phrases share adds nothing to either.
    """
    sent = texts.sparkSession.sparkContext.broadcast(Sieve.of(keys))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            yield _rows(words, words.lang, np.bincount(words.lang), None, 0)
            ids = words.found.distinct(words.keys, words.lang)
            for size, (at, _, passed) in enumerate(words.levels(sent.value), 1):
                at = at[passed]
                # A phrase is its first words and its last: exact, whatever the keys.
                names = ids[at] if size == 1 else number[at] * (len(ids) + 1) + ids[at + size - 1]
                _, first, again, often = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
                number = np.zeros(len(ids), np.int64)
                number[at] = again
                for a in range(0, len(first), 50_000):
                    some = at[first[a : a + 50_000]]
                    yield _rows(words, words.lang[some], often[a : a + 50_000], some, size)

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, size tinyint, f bigint")
    counted = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return counted.filter((F.col("f") >= min_count) | (F.col("size") == 0))


def _rows(words: Slice, lang: np.ndarray, often: np.ndarray, at: np.ndarray | None, size: int) -> pa.RecordBatch:
    if at is None:  # all words of each language
        codes = np.flatnonzero(often)
        lang, often, phrase = codes, often[codes], pa.array([""] * len(codes), pa.string())
    else:
        phrase = words.found.joined(at, size)
    sizes = pa.array(np.full(len(often), size, np.int8))
    return pa.RecordBatch.from_arrays(
        [words.langs.take(pa.array(lang)), phrase, sizes, pa.array(often.astype(np.int64))], names=["lang", "phrase", "size", "f"]
    )


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``a``, ``l``, ``r``, ``score``: phrases of two words or more by their weakest cut."""
    parts = counts.filter((F.col("size") > 0) & (F.col("size") < MAX_WORDS)).select("lang", F.col("phrase").alias("part"), F.col("f"))
    words = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(
            k.cast("int").alias("k"),
            F.array_join(F.slice(words, 1, k), " ").alias("head"),
            F.array_join(F.slice(words, k + 1, F.col("size")), " ").alias("tail"),
        ),
    )
    cuts = counts.filter(F.col("size") > 1).select("lang", "phrase", "size", F.col("f").alias("a"), F.inline(cut))
    heads = parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.call_function("div", _wide(F.col("a")) * F.lit(SCORE_SCALE), _wide(F.col("l")) + _wide(F.col("r")))
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    return met.groupBy("lang", "phrase", "size", "a").agg(weakest).select("lang", "phrase", "size", "a", "w.l", "w.r", "w.score")


def covers(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``around``: the largest count of a longer phrase with ``phrase`` (two words or more) inside."""
    words = F.split("phrase", " ")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("size") - n + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.col("size") > n, found).otherwise(F.array().cast("array<string>"))

    inside = F.flatten(F.array(*[runs(n) for n in range(2, MAX_WORDS)]))
    longer = counts.filter(F.col("size") > 2).select("lang", "f", F.explode(inside).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(
    docs: DataFrame,
    doc_id: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    sample: int = SAMPLE,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut, ``n``
    the language's words.  A phrase goes if a longer frequent one around it has nearly as
    many occurrences.  Ties go by count, then by the phrase's bytes.  Counts are of
    occurrences in all rows, repeated rows too; NULL and empty texts have none; a NULL
    language is ``UNKNOWN_LANG``; ``doc_id`` only deals rows to the sample and may be NULL; an
    empty table gives no rows; other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("deal"),
    )
    keys = frequent_keys(texts, F.pmod("deal", F.lit(sample)) == 0, 1 / sample, min_count)
    counts = stored(phrase_counts(texts, keys, min_count), "phrase_counts")
    around = covers(counts)
    left = scored(counts).join(around, ["lang", "phrase"], "left")
    left = left.filter(F.col("around").isNull() | (100 * _wide(F.col("around")) < COVERED * _wide(F.col("a"))))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
