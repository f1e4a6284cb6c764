"""Rules for text quality, judged by document and by host.

Built-in expressions only.  A document's measures come from one pass over its text; nothing
is exploded, so a long document costs its own task and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.text import free_name, quoted, words
from forecourt.workspace import stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rules beside the base: the share of symbols among characters, of repeated lines among
#: lines, and the mean length of a word.
MAX_SYMBOL_SHARE = 0.05
MAX_DUP_LINE_SHARE = 0.4
WORD_LENGTHS = (2.0, 15.0)
#: A host whose shrunk failure rate is above the first loses its doubtful documents (those
#: that fail a rule outside the base); above the second it loses all its documents.
DOUBTFUL_RATE, HOPELESS_RATE = 0.05, 0.8
SYMBOLS = "[#*$%&|<>]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(all_words: Column, window: int) -> Column:
    """Words in windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hash.  Only texts whose windows are not all distinct are
    sorted; covered words are then summed over the sorted starts of repeated windows.
    """
    n = F.size(all_words)
    starts = F.sequence(F.lit(0), n - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(all_words, i + 1, window)))
    return F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, window: int) -> Column:
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def from_sorted(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        flagged = F.filter(
            F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()
        )
        begin = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-window).alias("last"))
        step = lambda acc, i: F.struct(
            (acc["total"] + F.least(F.lit(window), i - acc["last"])).alias("total"), i.alias("last")
        )
        return F.aggregate(F.array_sort(flagged), begin, step, lambda acc: acc["total"])

    # A one-element array binds the sorted windows to a name, so they are sorted once.
    return F.get(F.transform(F.array(ordered), from_sorted), F.lit(0))


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, each computed once per row.

    A filter or projection above would otherwise be merged with the expressions and repeat
    them wherever it names them; a generator of one row keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its measures and rule verdicts; also the names they have got.

    The names are ``MEASURES``, ``base_failed``, ``doubtful`` and ``host``, with underscores
    added where ``docs`` has such a column.  NULL text counts as empty (it fails the base).
    """
    at = {n: free_name(docs, n) for n in [*MEASURES, "base_failed", "doubtful", "host", "_words", "_lines", "_windows"]}
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    cut = evaluated(docs, {at["_words"]: words(body), at["_lines"]: lines})
    hashed = evaluated(cut, {at["_windows"]: _repeated_words(F.col(at["_words"]), WINDOW)})
    windows = F.col(at["_windows"])
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    n_lines = free_name(docs, "_n_lines")
    found = evaluated(
        hashed,
        {
            at["n_words"]: F.size(at["_words"]).cast("bigint"),
            at["word_chars"]: F.length(F.array_join(at["_words"], "")).cast("bigint"),
            at["n_symbols"]: F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
            at["n_dup_lines"]: (F.size(at["_lines"]) - F.size(F.array_distinct(at["_lines"]))).cast("bigint"),
            at["n_repeat_words"]: F.when(repeats, _covered(windows, WINDOW)).otherwise(F.lit(0)).cast("bigint"),
            n_lines: F.size(at["_lines"]),
        },
    )
    n, chars = F.col(at["n_words"]), F.col(at["word_chars"])
    doubtful = (
        (F.col(at["n_symbols"]) > MAX_SYMBOL_SHARE * chars)
        | (F.col(at["n_dup_lines"]) > MAX_DUP_LINE_SHARE * F.col(n_lines))
        | (chars < WORD_LENGTHS[0] * n)
        | (chars > WORD_LENGTHS[1] * n)
    )
    base = (n < MIN_WORDS) | (100 * F.col(at["n_repeat_words"]) > MAX_REPEAT_PERCENT * n)
    found = found.withColumns({at["base_failed"]: base, at["host"]: F.col(host)}).withColumn(at["doubtful"], doubtful)
    return found.drop(at["_words"], at["_lines"], at["_windows"], n_lines), at


def host_rates(found: DataFrame, at: dict[str, str]) -> DataFrame:
    """``host``, ``host_docs``, ``host_failures`` and ``host_rate`` for every host.

    Failures are counted in each task, so a host with a third of all rows is one row per
    task.  The rate is the mean of a beta distribution: the prior is fitted to all hosts by
    the moments of their rates (weighted by documents), so small hosts lean on the rest.
    A NULL host is a host of its own.
    """
    failed = F.col(at["base_failed"]) | F.col(at["doubtful"])
    hosts = stored(
        found.groupBy(F.col(at["host"]).alias("host")).agg(
            F.count("*").alias("host_docs"), F.sum(failed.cast("bigint")).alias("host_failures")
        ),
        "hosts",
    )
    rate = F.col("host_failures") / F.col("host_docs")
    sums = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failures").alias("k"),
        F.sum(F.col("host_docs") * rate * rate).alias("square"),
        F.count("*").alias("hosts"),
    ).first()
    alpha, beta = beta_prior(sums["n"] or 0, sums["k"] or 0, sums["square"] or 0.0, sums["hosts"])
    shrunk = (F.col("host_failures") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk)


def beta_prior(n: int, k: int, square: float, hosts: int) -> tuple[float, float]:
    """Parameters of the beta prior with the weighted mean and variance of the host rates.

    The variance that binomial noise alone would give is taken off first.  Where nothing is
    left, hosts do not differ and the prior is as strong as all documents together; where
    all documents fail or none does, it is one document strong.
    """
    if not n:
        return 0.5, 0.5
    mean = k / n
    if mean in (0.0, 1.0):
        return mean, 1.0 - mean
    spread = square / n - mean * mean - mean * (1 - mean) * hosts / n
    strength = float(n) if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 1.0), float(n))
    return mean * strength, (1 - mean) * strength


def judged(found: DataFrame, hosts: DataFrame, at: dict[str, str]) -> DataFrame:
    """``found`` with ``host_rate`` and ``kept`` (renamed on a clash; see ``verdicts``).

    Not kept: documents that fail the base, doubtful ones of a host with a raised rate, and
    all of a host beyond hope.  The host table is joined as the planner sees fit: broadcast
    when its file is small, else shuffled with hot hosts split.
    """
    rate, kept = free_name(found, "host_rate"), free_name(found, "kept")
    key = free_name(found, "_host_key")
    side = hosts.select(F.col("host").alias(key), F.col("host_rate").alias(rate))
    joined = found.join(side, found[at["host"]].eqNullSafe(side[key]), "left").drop(key)
    bad = (
        F.col(at["base_failed"])
        | (F.col(at["doubtful"]) & (F.col(rate) > DOUBTFUL_RATE))
        | (F.col(rate) > HOPELESS_RATE)
    )
    at |= {"host_rate": rate, "kept": kept}
    return joined.withColumn(kept, ~bad)


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``docs``: its number, host, measures, host rate and ``kept``.

    Texts are read once; the measures are written to the shared folder for the second use.
    NULL text has no words and fails the base; repeated rows each count and each get a row;
    other columns are not read; an empty table gives no rows.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source"))
    found, at = measured(read)
    found = stored(found.drop("text"), "measures")
    return judged(found, host_rates(found, at), at).drop(at["host"])


def filtered(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    Rows are written with their measures once, then joined with the hosts.  NULL, empty and
    blank texts fail the base and go; repeated rows are judged alike and all stay or go;
    columns are kept as they are, also those with dots in their names or the names of measures; an empty table gives no
    rows.
    """
    found, at = measured(docs, text, host)
    found = stored(found, "measured_documents")
    result = judged(found, host_rates(found, at), at)
    return result.filter(F.col(at["kept"])).select(*[F.col(quoted(c)) for c in docs.columns])
