"""Registered queries of this subpackage over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm import (
    bpe, divergence, embedding_dedup, html_extract, license_scan, line_dedup, lm_score, packing, phrases, quality, sharding, simhash, suffix_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACE = r"[ \t\n\x0B\f\r]+"


def words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda x: x <> '')"


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("_doc").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@query(
    rf"""WITH texts AS (
      SELECT doc_id, source, coalesce(text, '') AS text, {words_of('text')} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8) a) b),
    covered AS (
      SELECT doc_id, CAST(sum(least(8, gap)) AS BIGINT) AS n FROM (
        SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8) AS gap FROM windows WHERE c > 1) g
      GROUP BY doc_id),
    measured AS (
      SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n, 0) AS n_repeat_words
      FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id),
    ruled AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_symbols > {quality.MAX_SYMBOL_SHARE}::DOUBLE * word_chars OR n_dup_lines > {quality.MAX_DUP_LINE_SHARE}::DOUBLE * n_lines
             OR word_chars < {quality.WORD_LENGTHS[0]} * n_words OR word_chars > {quality.WORD_LENGTHS[1]} * n_words AS doubtful
      FROM measured),
    hosts AS (
      SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR doubtful) AS DOUBLE) AS k
      FROM ruled GROUP BY source),
    moments AS (
      SELECT sum(n) AS docs, sum(k) / sum(n) AS mean,
             sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n))
             - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS spread FROM hosts),
    prior AS (
      SELECT mean, CASE WHEN mean IN (0, 1) THEN 1 WHEN spread <= 0 THEN docs
                        ELSE least(greatest(mean * (1 - mean) / spread - 1, 1), docs) END AS strength FROM moments),
    rates AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, doubtful,
           round(rate, 6) AS host_rate,
           NOT (base_failed OR (doubtful AND rate > {quality.DOUBTFUL_RATE}) OR rate > {quality.HOPELESS_RATE}) AS kept
    FROM ruled d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source"""
)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality.verdicts(read(spark, sf_dir, "documents"))
    return found.drop("source").withColumn("host_rate", F.round("host_rate", 6))


@query(
    rf"""WITH cut AS (
      SELECT doc_id, line, {words_of('value')} AS w FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
               unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) l),
    lines AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS whole FROM cut WHERE len(w) > 0),
    firsts AS (
      SELECT whole, any_value(w) AS w, min({{'doc': doc_id, 'line': line}}) AS first, len(any_value(w)) AS n FROM lines GROUP BY whole),
    variants AS (
      SELECT whole, first, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS key
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {line_dedup.NEAR_WORDS}) a),
    replaced AS (SELECT whole, min(first) OVER (PARTITION BY key, i, n) AS best FROM variants),
    inserted AS (
      SELECT v.whole, f.first AS best FROM variants v JOIN firsts f ON f.whole = v.key AND f.n >= {line_dedup.NEAR_WORDS}
      UNION ALL
      SELECT f.whole, v.first FROM variants v JOIN firsts f ON f.whole = v.key AND f.n >= {line_dedup.NEAR_WORDS}),
    near AS (SELECT whole, min(best) AS best FROM (FROM replaced UNION ALL FROM inserted) o GROUP BY whole),
    earliest AS (
      SELECT f.whole, f.first, CASE WHEN n.best < f.first THEN n.best ELSE f.first END AS origin
      FROM firsts f LEFT JOIN near n ON n.whole = f.whole)
    SELECT doc_id, CAST(line AS INTEGER) AS line, origin.doc AS first_doc, CAST(origin.line AS INTEGER) AS first_line,
           CASE WHEN origin = first THEN 0 ELSE 1 END AS edits
    FROM lines l JOIN earliest e ON e.whole = l.whole
    WHERE origin < {{'doc': doc_id, 'line': line}}"""
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats an earlier one, exactly or within one word."""
    found = line_dedup.duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("_doc").alias("doc_id"), "line", "first_doc", "first_line", "edits")


@query(
    rf"""WITH texts AS (SELECT doc_id, {words_of('text')} AS w FROM documents),
    windows AS (
      SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {suffix_dedup.PASSAGE}], ' ')) AS win
      FROM (SELECT *, unnest(range(len(w) - {suffix_dedup.PASSAGE - 1})) AS i FROM texts WHERE len(w) >= {suffix_dedup.PASSAGE}) a),
    shared AS (
      SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) = 1 AS original,
             count(*) OVER (PARTITION BY win) AS c FROM windows),
    marked AS (
      SELECT *, CASE WHEN i - lag(i) OVER one <= {suffix_dedup.PASSAGE} THEN 0 ELSE 1 END AS begins FROM shared WHERE c > 1
      WINDOW one AS (PARTITION BY doc_id, original ORDER BY i)),
    runs AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, original ORDER BY i) AS run FROM marked)
    SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + {suffix_dedup.PASSAGE} - min(i) AS INTEGER) AS words, original
    FROM runs GROUP BY doc_id, original, run"""
)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs more than once, with its first occurrence."""
    found = suffix_dedup.passages(read(spark, sf_dir, "documents"))
    return found.select(F.col("_doc").alias("doc_id"), "start", "words", "original")


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack_documents(
        read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and their decoded text, as digests."""
    return bpe.encode_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ids=False)


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    found = sharding.shards_by_bytes(read(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query(
    f"""WITH RECURSIVE vectors AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {embedding_dedup.COSINE}::DOUBLE),
    reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN components c ON c.vec_id = e.vec_id LEFT JOIN counts k ON k.vec_id = e.vec_id"""
)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query()
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under word counts and under the network."""
    return lm_score.scored(read(spark, sf_dir, "documents"))


@query()
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and expressions of every document."""
    return license_scan.summary(license_scan.scan(read(spark, sf_dir, "documents")))


@query(
    rf"""WITH docs AS (
      SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    terms AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS whole FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {divergence.MIN_DOCS}),
    counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(whole)::HUGEINT AS whole_n FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    full_ AS (
      SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
             1 + ({divergence.SCALE}::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p,
             1 + ({divergence.SCALE}::HUGEINT * (whole + 1)) // (whole_n + v) AS q
      FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
      LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    unlike AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN unlike u ON u.lang = a.lang AND u.source = a.source AND u.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM full_ WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) r
    WHERE part = 'pair' OR rank <= {divergence.TOP}"""
)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlikeness of all sources of a language, and the words each has more of."""
    return divergence.audit(read(spark, sf_dir, "documents")).drop("count", "share")


@query(
    rf"""WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents WHERE text IS NOT NULL),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
    runs AS (
      SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE len(w) >= size) a),
    counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
    cuts AS (
      SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
             array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c),
    weighed AS (
      SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, CAST({phrases.SCORE_SCALE}::HUGEINT * a // (h.f + t.f) AS BIGINT) AS score
      FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
    weakest AS (FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    around AS (
      SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') AS phrase, max(f) AS f
      FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM counts, (SELECT unnest([2, 3]) AS n) s WHERE size > n) c GROUP BY ALL),
    kept AS (
      SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
      WHERE o.f IS NULL OR 100 * o.f < {phrases.COVERED} * a)
    SELECT k.lang, rank, phrase, a, l, r, n, score FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k
    JOIN totals t ON t.lang = k.lang WHERE rank <= {phrases.TOP}"""
)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words go together most."""
    return phrases.collocations(read(spark, sf_dir, "documents"))
