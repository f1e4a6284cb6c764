"""Grouped counts, words and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.operators import dedup, stats, words
from forecourt.suite import query
from forecourt.suite.views import table

JAVA_SPACE = r"[ \t\n\x0B\f\r]+"


@query(
    "a5_topn_brand",
    """SELECT p_brand AS name, CAST(count(*) AS BIGINT) AS value
       FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY p_brand ORDER BY value DESC, name LIMIT 10""",
)
def a5_topn_brand(spark, sf_dir):
    # Counted per part before the join, so a part with a third of all rows joins as one row.
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    branded = sold.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return stats.top_counts(branded, "p_brand", 10, weight="n")


@query(
    "t3_default_top_n",
    """SELECT user_id AS name, CAST(count(*) AS BIGINT) AS value FROM events
       GROUP BY user_id ORDER BY value DESC, name LIMIT 10""",
)
def t3_default_top_n(spark, sf_dir):
    return stats.top_counts(table(spark, sf_dir, "events"), "user_id", 0)


@query(
    "a6_top_with_source_rows",
    """SELECT user_id AS name, CAST(count(*) AS BIGINT) AS value,
              (SELECT CAST(count(*) AS BIGINT) FROM events) AS source_rows
       FROM events GROUP BY user_id ORDER BY value DESC, name LIMIT 7""",
)
def a6_top_with_source_rows(spark, sf_dir):
    return stats.top_counts_with_total(table(spark, sf_dir, "events"), "user_id", 7)


@query(
    "p4_blank_after_limit",
    """SELECT trim(k) AS name, value FROM (
         SELECT k, CAST(count(*) AS BIGINT) AS value FROM (
           SELECT CASE WHEN user_id % 3 = 0 THEN '  ' WHEN user_id % 5 = 0 THEN NULL
                       ELSE ' ' || event_type || repeat(' ', CAST(user_id % 2 AS BIGINT)) END AS k FROM events) e
         GROUP BY k ORDER BY value DESC, k NULLS FIRST LIMIT 6) t
       WHERE trim(k) <> ''""",
)
def p4_blank_after_limit(spark, sf_dir):
    user = F.col("user_id")
    padding = F.when(user % 2 == 1, " ").otherwise("")
    key = (
        F.when(user % 3 == 0, F.lit("  "))
        .when(user % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), "event_type", padding))
    )
    keyed = table(spark, sf_dir, "events").select(key.alias("k"))
    return stats.drop_blank_names(stats.top_counts(keyed, "k", 6))


@query(
    "p5_column_fallback",
    """SELECT event_type AS name, CAST(count(*) AS BIGINT) AS value,
              'event_type' AS field, true AS fallback_field
       FROM events GROUP BY event_type ORDER BY value DESC, name LIMIT 3""",
)
def p5_column_fallback(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "props")
    column, fallback = stats.count_column(events, "brand")
    top = stats.top_counts(events, column, 3)
    return top.withColumn("field", F.lit(column)).withColumn("fallback_field", F.lit(fallback))


@query(
    "a1_word_frequency",
    f"""SELECT field, word, CAST(count(*) AS BIGINT) AS freq FROM (
          SELECT 'text' AS field, unnest(regexp_split_to_array(text, '{JAVA_SPACE}')) AS word FROM documents
          UNION ALL
          SELECT 'source', unnest(regexp_split_to_array(source, '{JAVA_SPACE}')) FROM documents
          UNION ALL
          SELECT 'n_chars', unnest(regexp_split_to_array(CAST(n_chars AS VARCHAR), '{JAVA_SPACE}')) FROM documents) w
        GROUP BY field, word""",
)
def a1_word_frequency(spark, sf_dir):
    names = ["text", "source", "n_chars"]
    return words.word_frequency(table(spark, sf_dir, "documents"), {n: F.col(n) for n in names})


@query(
    "a1_padded_fields",
    f"""SELECT field, word, CAST(count(*) AS BIGINT) AS freq FROM (
          SELECT 'p_name' AS field,
                 unnest(regexp_split_to_array('  ' || p_name || ' ', '{JAVA_SPACE}')) AS word FROM part
          UNION ALL
          SELECT 'p_type', unnest(regexp_split_to_array(p_type, '{JAVA_SPACE}')) FROM part
          WHERE p_size % 4 <> 0) w
        GROUP BY field, word""",
)
def a1_padded_fields(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    sparse = F.when(F.col("p_size") % 4 != 0, F.col("p_type"))
    return words.word_frequency(part, {"p_name": padded, "p_type": sparse})


@query(
    "p2_null_drop",
    """SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT CASE WHEN p_size % 4 <> 0 THEN p_type END AS kind FROM part) p
       WHERE kind IS NOT NULL GROUP BY kind""",
)
def p2_null_drop(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kinds = part.select(F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("kind"))
    return kinds.dropna(subset=["kind"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "a2_token_count",
    r"""SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (
          SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents) w
        WHERE word <> '' GROUP BY word""",
)
def a2_token_count(spark, sf_dir):
    return words.token_count(table(spark, sf_dir, "documents"), "text")


@query(
    "a3_space_tokens",
    """SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (
         SELECT unnest(string_split(cut, ' ')) AS word FROM (
           SELECT line, rtrim(line, ' ') AS cut FROM (
             SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l) c
         WHERE NOT (cut = '' AND line <> '')) w
       GROUP BY word""",
)
def a3_space_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("value"))
    return words.space_token_count(lines)


@query(
    "a4_comma_tokens",
    """SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (
         SELECT unnest(string_split(rtrim(line, ','), ',')) AS word FROM (
           SELECT event_type || ',,' || props || CASE WHEN user_id % 2 = 0 THEN ',,' ELSE '' END AS line
           FROM events) l) w
       GROUP BY word""",
)
def a4_comma_tokens(spark, sf_dir):
    tail = F.when(F.col("user_id") % 2 == 0, ",,").otherwise("")
    line = F.concat(F.col("event_type"), F.lit(",,"), F.col("props"), tail)
    return words.comma_token_count(table(spark, sf_dir, "events").select(line.alias("value")))


@query("a15_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def a15_distinct_rows(spark, sf_dir):
    return dedup.dedup_columns(table(spark, sf_dir, "documents").select("text", "lang"), dedup.ALL_FIELDS)


@query(
    "a16_dedup_key",
    """SELECT event_id, ts, user_id, event_type, value, props FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) e
       WHERE rn = 1""",
)
def a16_dedup_key(spark, sf_dir):
    return dedup.dedup_columns(table(spark, sf_dir, "events"), "user_id,event_type", [F.col("event_id")])


@query(
    "a16_dedup_line_fields",
    """SELECT min(value) AS value FROM (
         SELECT CAST(user_id AS VARCHAR) || ',' || props
                || CASE WHEN user_id % 3 = 0 THEN '' ELSE ',' || event_type END AS value,
                user_id AS k1, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS k3 FROM events) e
       GROUP BY k1, k3""",
)
def a16_dedup_line_fields(spark, sf_dir):
    tail = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("event_type")))
    line = F.concat(F.col("user_id").cast("string"), F.lit(","), F.col("props"), tail)
    return dedup.dedup_lines(table(spark, sf_dir, "events").select(line.alias("value")), "1, 3")


@query(
    "u2_distinct_union",
    """SELECT lang AS value FROM documents UNION SELECT event_type FROM events
       UNION SELECT p_name FROM part""",
)
def u2_distinct_union(spark, sf_dir):
    parts = [("documents", "lang"), ("events", "event_type"), ("part", "p_name")]
    union = None
    for name, column in parts:
        one = table(spark, sf_dir, name).select(F.col(column).alias("value"))
        union = one if union is None else union.unionByName(one)
    return dedup.distinct_rows(union)
