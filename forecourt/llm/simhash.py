"""Near-duplicate texts by SimHash fingerprints and tables of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.components import components
from forecourt.llm.text import only_keys, row_key, slices, utf8_column
from forecourt.workspace import stored

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Reference fingerprints.  The table holds the distance to each, in each part of the bits.
PIVOTS = 12
#: Fingerprints of one cell that are compared pair by pair; larger cells go by midpoints.
CELL_ROWS = 128
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is set if more than half of all shingle hashes have it.

    Words are cut at ASCII white space after lower-casing A-Z; shingles count as often as
    they occur; a shorter text is one shingle; a text without words gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.array([len(w) + 1 for w in words])
    first, last = starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(first)
    for block in range(0, total, _BLOCK):
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(first[block : block + _BLOCK], last[block : block + _BLOCK])),
            dtype="<u8",
            count=min(_BLOCK, total - block),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without its text but with the fingerprint as a signed 64-bit number.

    Texts are read whole, a few hundred rows at a time.
    """
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("bigint").alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [fingerprint(t, shingle_words) for t in utf8_column(batch, text)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*columns, signed], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: signed 64-bit numbers that depend on their index alone."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i) - (1 << 63) for i in range(count)]


def parts(max_bits: int) -> list[int]:
    """Masks (signed) that cut 64 bits into ``max_bits`` + 1 parts of nearly equal width."""
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distances(fp: Column, mask: int, count: int) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask))) for p in pivots(count)]


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """Edges ``a``, ``b`` that connect fingerprints (distinct, column ``fp``) at ``max_bits`` or less.

    Every fingerprint gets its table row: the distance to each pivot, kept by part of the
    bits.  Two fingerprints at ``max_bits`` or less agree in one of ``max_bits`` + 1 parts,
    so there all their distances are equal: that list of distances is the join key, a cell.
    A pair of one cell whose whole distances differ by more than ``max_bits`` at any pivot
    is discarded; what survives is compared bit by bit.  Nothing within the bound is lost.

    A cell with more than ``cell_rows`` fingerprints (very many variants of one text) is not
    paired up: each member names every fingerprint half the bound away from it, and two
    members within the bound name a common one, by way of which they are connected.  That is
    exact too and grows with the members, not with their pairs; edges may then lead over
    fingerprints that no document has.
    """
    table = prints.select("fp", *[F.array(*_distances(F.col("fp"), m, n_pivots)).alias(f"d{i}") for i, m in enumerate(parts(max_bits))])
    names = [f"d{i}" for i in range(max_bits + 1)]
    whole = F.col(names[0])
    for n in names[1:]:
        whole = F.zip_with(whole, F.col(n), lambda x, y: x + y)
    cells = table.select(
        "fp",
        F.transform(whole, lambda d: d.cast("tinyint")).alias("whole"),
        F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col(n)) for i, n in enumerate(names)])).alias("part", "cell"),
    ).select("fp", "whole", "cell")
    cells = stored(cells, "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(cells.join(sizes, "cell"), "shared_cells")
    small = shared.filter(F.col("n") <= cell_rows)
    left = small.select("cell", F.col("fp").alias("a"), F.col("whole").alias("wa"))
    right = small.select("cell", F.col("fp").alias("b"), F.col("whole").alias("wb"))
    near = F.forall(F.zip_with("wa", "wb", lambda x, y: F.abs(x - y)), lambda d: d <= max_bits)
    pairs = left.join(
        right,
        (left["cell"] == right["cell"])
        & (F.col("a") < F.col("b"))
        & near
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits),
    ).select("a", "b")
    crowded = shared.filter(F.col("n") > cell_rows).select("fp").distinct()
    return pairs.unionByName(midpoint_edges(crowded, max_bits))


def midpoint_edges(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect all fingerprints at ``max_bits`` (even) or less, one per member and point.

    Every member names all points up to half the bound away.  Two members name a common
    point exactly if they are within the bound; the smallest namer stands for the point.
    """
    if max_bits % 2:
        raise ValueError("midpoints connect exactly for even bounds only")
    masks = {0}
    for _ in range(max_bits // 2):
        masks |= {m ^ (1 << b) for m in masks for b in range(64)}
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in sorted(masks)])
    named = prints.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    points = named.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return named.join(points, "point").filter("fp <> a").select("a", F.col("fp").alias("b"))


def link_components(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``fp`` and ``root``: fingerprints of one component of links share ``root``."""
    found = components(close_pairs(prints, max_bits, cell_rows))
    return (
        prints.join(found, prints["fp"] == found["node"], "left")
        .select(prints["fp"], F.coalesce("root", prints["fp"]).alias("root"))
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``_doc``, ``_hash``, ``fp``, ``root`` and ``component_id`` of every row of ``docs``.

    Equal fingerprints are one node of the graph, so exact copies cost one row each.
    ``component_id`` is the smallest number reachable by links, itself included; ``root`` is
    a fingerprint that tells components apart where rows share a number.  NULL and empty texts have fingerprint 0 and link like any other; rows with a NULL number get a
    row and link others, but name a component only if all its numbers are NULL.  Repeated
    rows all stay.  An empty table gives no rows; other columns are not read.
    """
    read = docs.select(*row_key(doc_id, text), F.col(text).alias("text"))
    rows = stored(fingerprints(read, "text", "fp", shingle_words), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("_doc").alias("first")), "prints")
    roots = prints.join(link_components(prints.select("fp"), max_bits, cell_rows), "fp")
    roots = stored(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(roots.join(smallest, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("_doc", "_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest number stays.

    Of several rows with that number the one with the smallest text hash stays, once.  A
    component without numbers keeps one row too.  All columns are kept as they are.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    # One row per component: combined in each task, so a hot component is no hot spot.
    first = F.min(F.struct(F.col("_doc").isNull().alias("last"), "_doc", "_hash")).alias("first")
    kept = found.groupBy("root").agg(first).select("first._doc", "first._hash")
    return only_keys(docs, stored(kept.distinct(), "kept"), doc_id, text, once=True)
