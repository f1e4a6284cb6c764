"""Segmenting long documents and joining segment results again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecourt.functions.text import SEGMENT_LIMIT, chunks, java_trim


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SEGMENT_LIMIT) -> DataFrame:
    """``(key, chunk_no, n_chunks, chunk)``, numbered from 1; the whole text is kept."""
    cut = docs.select(key, chunks(F.col(text), limit).alias("parts"))
    # The count is taken before exploding, so that no row carries all parts along.
    counted = cut.withColumn("n_chunks", F.size("parts"))
    return counted.select(key, "n_chunks", F.posexplode("parts").alias("pos", "chunk")).select(
        key, (F.col("pos") + 1).alias("chunk_no"), "n_chunks", "chunk"
    )


def recombined(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segment texts of a document under numbered headings, in order, trimmed."""
    heading = F.concat(F.lit("第 "), F.col("chunk_no").cast("string"), F.lit(" 段总结:\n"))
    pieces = F.array_sort(
        F.collect_list(F.struct("chunk_no", F.concat(heading, "chunk", F.lit("\n\n")).alias("t")))
    )
    joined = F.array_join(F.transform(pieces, lambda p: p["t"]), "")
    return parts.groupBy(key).agg(java_trim(joined).alias("combined"))
