"""Text expressions: tokens, chunks, dates in prose, defaults, JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They must equal the platform's own limits and messages.
SEGMENT_LIMIT = 65_536 - 100
ELLIPSIS_LIMIT = 300
EMPTY_TEXT_MESSAGE = "无可分析的文本"
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}", r"(19|20)\d{2}")


def whitespace_words(c: Column) -> Column:
    r"""Split on ``\s+``; an empty token appears where the text starts or ends with space."""
    return F.split(c, r"\s+")


def blank_separated(c: Column) -> Column:
    """Split on blanks, tabs and line breaks; the first and last part may be empty."""
    return F.split(c, r"[ \t\n\r\f]+")


def plain_tokens(c: Column) -> Column:
    """Tokens between blanks, tabs and line breaks, without empty ones."""
    return F.filter(blank_separated(c), lambda w: w != "")


def separated_tokens(c: Column, separator: str) -> Column:
    """Split on one separator; inner empty tokens stay, trailing ones go.

    A line of separators only has no token; an empty line has one empty token.
    """
    cut = F.rtrim(c, F.lit(separator))
    return F.when((cut == "") & (c != ""), F.array().cast("array<string>")).otherwise(
        F.split(cut, "\\" + separator)
    )


def field_at(c: Column, position: int, separator: str = ",") -> Column:
    """1-based field of a separated line; NULL when the line is too short."""
    if position < 1:
        raise ValueError("field positions start at 1")
    return F.get(F.split(c, "\\" + separator), position - 1)


def chunks(c: Column, limit: int = SEGMENT_LIMIT) -> Column:
    """Cut a text into pieces that concatenate back to it.

    While more than ``limit`` characters remain, the piece ends after the last ``.`` or
    newline at or before the limit index (at most ``limit + 1`` characters, at least two),
    else at the limit.  The pattern below says just that; ``+`` after a count keeps the
    first and last case from backtracking.
    """
    pattern = rf"(?s).{{1,{limit}}}+\z|.{{1,{limit}}}[.\n]|.{{1,{limit}}}+"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def date_in_text(c: Column) -> Column:
    """First full date, else first year-month, else first year 19xx/20xx, else NULL.

    Most texts have no four digits in a row and are passed over once, not three times.
    """
    found = [F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in DATE_PATTERNS]
    return F.when(c.rlike(r"\d{4}"), F.coalesce(*found))


def is_blank(c: Column) -> Column:
    return c.isNull() | (java_trim(c) == "")


def blank_default(c: Column, message: str = EMPTY_TEXT_MESSAGE) -> Column:
    return F.when(java_trim(c) == "", F.lit(message)).otherwise(F.coalesce(c, F.lit(message)))


def java_trim(c: Column) -> Column:
    r"""Strip every character up to U+0020 at both ends."""
    return F.btrim(c, F.lit("".join(map(chr, range(0x21)))))


def short_text(c: Column, limit: int = ELLIPSIS_LIMIT) -> Column:
    """Text of at most ``limit`` characters, longer ones cut with ``...``; NULL gives ''."""
    cut = F.concat(F.substring(c, 1, limit), F.lit("..."))
    return F.when(c.isNull(), F.lit("")).when(F.length(c) > limit, cut).otherwise(c)


def json_arguments(c: Column) -> Column:
    """JSON object as a string map; blank, malformed or non-object text gives an empty map."""
    empty = F.expr("cast(map() as map<string,string>)")
    parsed = F.try_variant_get(F.try_parse_json(c), "$", "map<string,string>")
    return F.coalesce(parsed, empty)
