"""Word and token counts.  All of them combine counts in each task before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions import text


def field_values(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Values of several columns as ``(field, value)`` text rows, in one pass, no NULLs."""
    pairs = [F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def count_field_words(values: DataFrame) -> DataFrame:
    words = F.explode(text.whitespace_words(F.col("value"))).alias("word")
    return values.select("field", words).groupBy("field", "word").agg(F.count("*").alias("freq"))


def word_frequency(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    r"""Words of several columns in one pass: ``(field, word, freq)``.

    Words are split on ``\s+``; leading or trailing space yields the empty word, which is
    counted.  NULL values are skipped, numbers are read as text.
    """
    return count_field_words(field_values(df, fields))


def _count_tokens(df: DataFrame, tokens: Column, kept: Column | None = None) -> DataFrame:
    words = df.select(F.explode(tokens).alias("word"))
    if kept is not None:
        words = words.filter(kept)
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def token_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace tokens of whole lines, no empty tokens."""
    # Empty parts are dropped as rows: that filter is compiled, one on arrays is not.
    return _count_tokens(lines, text.blank_separated(F.col(column)), F.col("word") != "")


def space_token_count(lines: DataFrame, column: str = "value") -> DataFrame:
    return _count_tokens(lines, text.separated_tokens(F.col(column), " "))


def comma_token_count(lines: DataFrame, column: str = "value") -> DataFrame:
    return _count_tokens(lines, text.separated_tokens(F.col(column), ","))

