"""Packing token sequences into rows of fixed length by hierarchical best fit.

Documents are tokenised once and cut into pieces; what is packed from then on are lengths.
Each round deals the open bins to tasks, fits them there, emits the bins that are nearly
full, and hands the others on as items of the next round, of fewer tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from forecourt.llm.text import slices
from forecourt.workspace import stored

SEQUENCE = 1024
END_ID = 2
#: Pieces that one task holds at a time; 24 bytes each and some.
TASK_PIECES = 200_000
#: A bin is nearly full when at most this share of it is free.
FREE_SHARE = 1 / 128

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PACKED = _PIECES + ", sequence_id bigint, offset bigint, used bigint, done boolean"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file (JSON text), whose ids are its merge ranks."""
    spec = json.loads(vocabulary)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str) -> Tokenizer:
    """The tokenizer of the file itself, without truncation or padding."""
    found = Tokenizer.from_str(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def token_ids(coder: tiktoken.Encoding, vocabulary: str, text: str) -> np.ndarray:
    """Ids of a text.  The faster library cannot match very long runs of white space (about a million
    characters); such texts go to the tokenizer itself."""
    try:
        return coder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, np.int64)


def cut(ids: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first takes what is left over."""
    total = len(ids)
    rest = total % length
    starts = [0, *range(rest, total, length)] if rest and total > length else [*range(0, total, length)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def pieces(
    docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
    length: int = SEQUENCE, end_id: int = END_ID,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every row.

    ``vocabulary`` is the text of a byte-level tokenizer file and goes to the tasks as a
    broadcast of its size (1.5 MB).  A document's ids are those of its whole text and then
    ``end_id``; only a document longer than ``length`` is cut, and then its first piece may be
    shorter.  NULL text is empty: one piece with the end alone.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(*sent.value)
        for batch in slices(batches, 512):
            rows: list[tuple] = []
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(token_ids(coder, sent.value[0], body or ""), end_id).astype("<u4")
                for k, (start, size) in enumerate(cut(ids, length)):
                    crc = zlib.crc32(ids[start : start + size].tobytes())
                    rows.append((number, k, start, size, crc))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of items, taken in descending size, each into the fullest bin it fits.

    Open bins wait in stacks by what is free in them; a bit mask of the stacks in use gives
    the tightest one in a few machine operations.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = stacks[free].pop()
            if not stacks[free]:
                open_mask ^= 1 << free
        else:
            free, chosen = capacity, made
            made += 1
        bins[i], offsets[i] = chosen, capacity - free
        free -= size
        if free:
            if not stacks[free]:
                open_mask |= 1 << free
            stacks[free].append(chosen)
    return bins, offsets


def _fit_round(rows: DataFrame, tasks: int, turn: int, length: int, last: bool) -> DataFrame:
    """One round: open bins, dealt to ``tasks`` tasks, are items; bins nearly full are done."""
    full = length - int(length * FREE_SHARE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        task = TaskContext.get().partitionId()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used"]
        got = {n: table.column(n).to_numpy(zero_copy_only=False) for n in names if n != "doc_id"}
        items, first, row_item = np.unique(got["sequence_id"], return_index=True, return_inverse=True)
        sizes = got["used"][first]
        bins, offsets = best_fit(sizes, length)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        row_bin = bins[row_item]
        fresh = (np.int64(turn) << 56) | (np.int64(task) << 32)
        columns = {
            "sequence_id": fresh + row_bin,
            "offset": got["offset"] + offsets[row_item],
            "used": used[row_bin],
            "done": (used[row_bin] >= full) | last,
        }
        out = [table.column("doc_id").combine_chunks()]
        out += [pa.array(got[n]) for n in names[1:5]] + [pa.array(c) for c in columns.values()]
        whole = pa.RecordBatch.from_arrays(out, names=[*names[:5], *columns])
        yield from slices([whole], 10_000)

    if turn:
        # All rows of a bin to one task; bins are many and of bounded size, so keys are even.
        dealt = rows.repartition(tasks, F.xxhash64("sequence_id", F.lit(turn)))
    else:
        dealt = rows.repartition(tasks)
    return dealt.mapInArrow(run, _PACKED)


def packed(items: DataFrame, length: int = SEQUENCE, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``items`` (a stored table as ``pieces`` gives) with ``sequence_id`` and ``offset``.

    Round 0 deals pieces to tasks of ``task_pieces`` at most and best-fits them by
    descending length.  Bins with less than ``FREE_SHARE`` free are done.  Each later round
    takes the open bins, whole, as items of a quarter of the tasks (as many as their rows
    ask for, so a task's memory stays bounded) and fits again.  The last round is that of
    one task, or the first that cannot join a fiftieth of its bins: what is open then fits
    nothing, wherever it is sent.  Rounds are written to the shared folder.
    """
    start = items.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        F.col("length").alias("used"), F.lit(False).alias("done"),
    )
    rows, bins = items.count(), None
    tasks = max(1, -(-rows // task_pieces))
    result = None
    turn = 0
    while True:
        last = tasks == 1
        fitted = stored(_fit_round(start, tasks, turn, length, last), "packed")
        done = fitted.filter("done")
        result = done if result is None else result.unionByName(done)
        if last:
            break
        start = fitted.filter("NOT done")
        left = start.agg(F.count("*").alias("rows"), F.count_distinct("sequence_id").alias("bins")).first()
        if not left["rows"]:
            break
        if bins is not None and left["bins"] > 0.98 * bins:
            result = result.unionByName(start)
            break
        bins = left["bins"]
        tasks = max(-(-tasks // 4), -(-left["rows"] // task_pieces))
        turn += 1
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
    length: int = SEQUENCE, end_id: int = END_ID, task_pieces: int = TASK_PIECES,
) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and its place there.

    Rows with equal or NULL numbers are packed each for itself; empty and NULL texts are one
    end token; an empty table gives no rows; other columns are not read.
    """
    items = stored(pieces(docs, vocabulary, pattern, doc_id, text, length, end_id), "pieces")
    return packed(items, length, task_pieces)
