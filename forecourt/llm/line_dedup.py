"""Duplicate lines across documents, exact and within one word's edit.

Built-in expressions only.  A line is what lies between newlines; its words are cut at ASCII
white space and compared exactly.  Two lines match if their words are equal, or if both have
``near_words`` or more and one word inserted, deleted or replaced makes them equal.  A line
that matches an earlier one (by document number, then text hash, then place) is a duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.text import free_name, joined_by_key, quoted, row_key, words
from forecourt.workspace import stored

#: Shorter lines match exactly only, unless a caller says otherwise: one word in fewer is no small edit.
NEAR_WORDS = 10


def _order(prefix: str = "") -> Column:
    """Earlier lines first; documents without a number come last."""
    fields = [F.col(f"{prefix}{c}") for c in ("_doc", "_hash", "line")]
    return F.struct(fields[0].isNull().alias("last"), *[f.alias(n) for f, n in zip(fields, ("doc", "hash", "line"))])


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """``_doc``, ``_hash``, ``line`` and, per line with words, their number ``n`` and two kinds of hashes.

    ``digest`` is that of all words.  ``ends`` are those of either half: of two lines one
    edit apart, whose shorter (or equal) length is m, one half of m / 2 words at the same end
    is equal, so a line names its halves for its own length and for one less.  The text of
    lines does not leave the task.
    """
    if near_words < 3:
        raise ValueError("lines of two words have no halves to share")
    cut = docs.select(*row_key(doc_id, text), F.posexplode(F.split(F.col(text), "\n")).alias("line", "value"))
    cut = cut.select("_doc", "_hash", "line", words(F.col("value")).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    ends = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        ends.append(F.xxhash64(F.lit("head"), m, F.slice("w", F.lit(1), half)))
        ends.append(F.xxhash64(F.lit("tail"), m, F.slice("w", n - half + 1, half)))
    return cut.select(
        "_doc", "_hash", "line", n.alias("n"), F.xxhash64("w").alias("digest"), F.when(n >= near_words, F.array(*ends)).alias("ends")
    )


def variants(lines: DataFrame) -> DataFrame:
    """Every line of ``lines`` (column ``w``) with one word left out, and whole, as hashed keys.

    The hash of a sequence is the exclusive or of the hashes of (word, place).  With running
    values from the front, and from the back for words that move up one place, each of a
    line's variants takes constant time; running values are kept per block of about the
    square root of the line, so a very long line does not take quadratic time or space.
    Columns: ``place`` (the word left out, -1 for none), ``key``, and those given but ``w``.
    """
    xor = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))
    kept = [c for c in lines.columns if c != "w"]
    n = F.size("w")
    # What leaving word i out changes: words before it stay, words behind it move.
    hashed = lines.select(
        *kept,
        n.alias("n_"),
        F.ceil(F.sqrt(n)).cast("int").alias("block"),
        F.transform("w", lambda word, i: F.xxhash64(word, i)).alias("stay"),
        F.transform("w", lambda word, i: F.xxhash64(word, i - 1)).alias("move"),
    )
    hashed = hashed.withColumn("flip", F.zip_with("stay", "move", lambda a, b: a.bitwiseXOR(b)))
    blocks = F.sequence(F.lit(0), F.floor((F.col("n_") - 1) / F.col("block")).cast("int"))
    summed = hashed.withColumns(
        {
            "whole": xor(F.col("stay")),
            "moved": xor(F.col("move")),
            "sums": F.transform(blocks, lambda b: xor(F.slice("flip", b * F.col("block") + 1, F.col("block")))),
        }
    )
    summed = summed.withColumn("before", F.transform(blocks, lambda b: xor(F.slice("sums", F.lit(1), b))))

    def without(i: Column) -> Column:
        b = F.floor(i / F.col("block")).cast("int")
        inside = xor(F.slice("flip", b * F.col("block") + 1, i - b * F.col("block")))
        prefix = F.get("before", b).bitwiseXOR(inside)
        # All moved, but those before i taken back to their places, and word i out.
        return F.col("moved").bitwiseXOR(prefix).bitwiseXOR(F.get("move", i))

    keyed = summed.select(
        *kept,
        "whole",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_") - 1), without)).alias("place", "key"),
    )
    left_out = keyed.select(*kept, "place", "key")
    whole = summed.select(*kept, F.lit(-1).alias("place"), F.col("whole").alias("key"))
    return left_out.unionByName(whole)


def near_lines(docs: DataFrame, firsts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``digest`` and ``best`` (an earlier line one edit away) of distinct lines that have one.

    Only lines that share a half with another line can be one edit from it, so only those
    get variants.  A variant that no other line has is dropped by counts, and what is left
    meets in aggregates that keep the earliest line; both combine in each task, so a template
    with very many fillings is one row per task.  Every match is then verified word by word.
    """
    long = firsts.filter(F.col("ends").isNotNull())
    ends = long.select("digest", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("k")).filter("k > 1").select("end")
    candidates = ends.join(shared, "end", "left_semi").select("digest").distinct()
    chosen = stored(long.join(candidates, "digest", "left_semi").select("digest", "n", "first"), "candidate_lines")
    # The words are fetched from the documents, each read once.
    per_doc = chosen.groupBy(F.col("first.doc").alias("_doc"), F.col("first.hash").alias("_hash")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "digest")).alias("chosen")
    )
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = joined_by_key(source, per_doc, "doc_id", "text", "inner")
    fetched = found.select(F.split("text", "\n").alias("lines"), F.explode("chosen").alias("c")).select(
        "c.digest", words(F.get("lines", F.col("c.line"))).alias("w")
    )
    # Rows that share a number and a text bring the same lines.
    fetched = stored(fetched.dropDuplicates(["digest"]), "fetched_lines")
    keyed = stored(variants(fetched.select("digest", F.size("w").alias("n"), "w")), "variants")
    met = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    met = keyed.join(met, "key", "left_semi").join(chosen.select("digest", "first"), "digest")
    met = stored(met, "shared_variants")
    line = F.struct("first", "digest")
    out = F.col("place") >= 0
    # Inserted or deleted: a whole line equals a variant of a line one longer.
    size = F.when(out, F.col("n") - 1).otherwise(F.col("n"))
    whole = met.groupBy("key", size.alias("m")).agg(F.min(F.when(out, line)).alias("cut"), F.min(F.when(~out, line)).alias("whole"))
    whole = whole.filter("cut IS NOT NULL AND whole IS NOT NULL")
    inserted = met.withColumn("m", size).join(whole, ["key", "m"]).withColumn("best", F.when(out, F.col("whole")).otherwise(F.col("cut")))
    # Replaced: of lines of one length the same word is left out.
    same = met.filter(out).groupBy("key", "place", "n").agg(F.min(line).alias("best"), F.count("*").alias("k")).filter("k > 1")
    replaced = met.filter(out).join(same.drop("k"), ["key", "place", "n"])
    offers = (
        inserted.select("digest", "first", "best")
        .unionByName(replaced.select("digest", "first", "best"))
        .filter(F.col("best.first") < F.col("first"))
        .select("digest", F.col("best.first").alias("best"), F.col("best.digest").alias("other"))
        .distinct()
    )
    offers = stored(offers, "offers")
    mine = fetched.select(F.col("digest").alias("d1"), F.col("w").alias("w1"))
    theirs = fetched.select(F.col("digest").alias("d2"), F.col("w").alias("w2"))
    checked = (
        offers.join(mine, offers["digest"] == mine["d1"])
        .join(theirs, offers["other"] == theirs["d2"])
        .filter(one_edit(F.col("w1"), F.col("w2")))
    )
    return checked.groupBy("digest").agg(F.min("best").alias("best"))


def one_edit(a: Column, b: Column) -> Column:
    """True if the word lists are equal, or equal after one word is inserted, deleted or replaced."""
    prefix = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)),
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda acc, same: F.struct((acc["on"] & same).alias("on"), F.when(acc["on"] & same, acc["n"] + 1).otherwise(acc["n"]).alias("n")),
        lambda acc: acc["n"],
    )
    rest = lambda words_, start: F.slice(words_, start, F.greatest(F.size(words_) - start + 1, F.lit(0)))

    def after(p: Column) -> Column:
        na, nb = F.size(a), F.size(b)
        return (
            ((na == nb) & (rest(a, p + 2) == rest(b, p + 2)))
            | ((na == nb + 1) & (rest(a, p + 2) == rest(b, p + 1)))
            | ((na + 1 == nb) & (rest(a, p + 1) == rest(b, p + 2)))
        )

    return F.get(F.transform(F.array(prefix), after), F.lit(0))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """One row per duplicate line: ``_doc``, ``_hash``, ``line``, the earlier line and ``edits``.

    ``first_doc`` and ``first_line`` name the earliest match (an equal line before a near one
    if it is earlier); ``edits`` is 0 or 1, and 0 for lines below ``near_words`` words (3 at least).  Lines without words are never duplicates.  NULL
    and empty texts have none; repeated rows share one row per line; an empty table gives no
    rows; other columns are not read.
    """
    lines = stored(line_table(docs, doc_id, text, near_words), "lines")
    firsts = stored(
        lines.groupBy("digest").agg(
            F.min(_order()).alias("first"), F.first("n").alias("n"), F.first("ends").alias("ends"), F.count("*").alias("k")
        ),
        "first_lines",
    )
    near = stored(near_lines(docs, firsts, doc_id, text), "near_lines")
    repeated = firsts.select("digest", "first", "k").join(near, "digest", "left").filter("k > 1 OR best IS NOT NULL")
    repeated = stored(repeated.select("digest", "first", F.least(F.col("best"), F.col("first")).alias("earliest")), "repeated_lines")
    found = lines.select("_doc", "_hash", "line", "digest").join(repeated, "digest").filter(F.col("earliest") < _order())
    return found.select(
        "_doc",
        "_hash",
        "line",
        F.col("earliest.doc").alias("first_doc"),
        F.col("earliest.line").alias("first_line"),
        F.when(F.col("earliest") == F.col("first"), 0).otherwise(1).alias("edits"),
    ).distinct()


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, near_words: int = NEAR_WORDS
) -> DataFrame:
    """``docs`` without duplicate lines; documents left without any word go, if lines were taken.

    All columns are kept, also those with dots in their names; ``n_chars``, if given, is set to the new length
    where lines went.  NULL and empty texts have no lines and stay as they are; repeated rows
    share their lines' fate; an empty table gives no rows.
    """
    gone = duplicates(docs, doc_id, text, near_words).groupBy("_doc", "_hash").agg(F.collect_list("line").alias("_gone"))
    name = free_name(docs, "_gone")
    joined = joined_by_key(docs, stored(gone.withColumnRenamed("_gone", name), "gone"), doc_id, text, "left")
    lines = F.split(F.col(text), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(name))
    rest = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    after = free_name(docs, "_after")
    result = joined.withColumn(after, F.when(F.col(name).isNull(), F.col(text)).otherwise(rest))
    result = result.filter(F.col(name).isNull() | F.col(after).rlike(r"[^ \t-\r]"))
    columns = []
    for c in docs.columns:
        value = docs[quoted(c)]
        if c == text:
            value = F.col(after)
        elif c == n_chars:
            value = F.when(F.col(name).isNull(), docs[quoted(c)]).otherwise(F.length(after).cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return result.select(*columns)
