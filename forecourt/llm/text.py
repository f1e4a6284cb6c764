"""Column expressions and small helpers shared by the operators on text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, the only separators of words.
SPACE = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_doc`` and ``_hash``: what tells one document from another.

    Rows that agree in both number and text are the same document; they share its decisions.
    """
    return [F.col(doc_id).cast("bigint").alias("_doc"), F.xxhash64(F.col(text)).alias("_hash")]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A column's name as Spark parses it back, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def with_key(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the two columns of ``row_key`` under names that clash with none of its own."""
    names = free_name(docs, "_doc"), free_name(docs, "_hash")
    key = row_key(doc_id, text)
    return docs.select("*", *[k.alias(n) for k, n in zip(key, names)]), *names


def joined_by_key(docs: DataFrame, found: DataFrame, doc_id: str, text: str, how: str) -> DataFrame:
    """``docs`` joined with ``found`` (``_doc``, ``_hash`` and others, all with free names)."""
    left, doc, digest = with_key(docs, doc_id, text)
    same = left[doc].eqNullSafe(found["_doc"]) & (left[digest] == found["_hash"])
    return left.join(found, same, how)


def only_keys(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose document is in ``keys``; ``once`` keeps one of repeated rows."""
    left, doc, digest = with_key(docs, doc_id, text)
    same = left[doc].eqNullSafe(keys["_doc"]) & (left[digest] == keys["_hash"])
    kept = left.join(keys, same, "left_semi")
    if once:
        kept = kept.dropDuplicates([doc, digest])
    return kept.drop(doc, digest)


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; NULL as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a step derives from a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
