"""Conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import text
from forecourt.operators import conversations, documents
from forecourt.suite import query, views
from forecourt.suite.views import CALL_FRAGMENTS, CHAT, table

ORPHAN = "(role = 'tool' OR (role = 'assistant' AND tool_calls IS NOT NULL))"
COLUMNS = "session_id, id, role, content, tool_calls"


@query(
    "p15_displayable",
    f"""WITH {CHAT} SELECT {COLUMNS} FROM chat WHERE role IN ('user', 'assistant')
        AND NOT (role = 'assistant' AND tool_calls IS NOT NULL) AND trim(content) <> ''""",
)
def p15_displayable(spark, sf_dir):
    return conversations.displayable(views.chat(spark, sf_dir))


def _latest_sql(n: int) -> str:
    return f"""last AS (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM chat
      QUALIFY back <= {n})"""


def _position_sql(n: int) -> str:
    return f"""WITH {CHAT}, {_latest_sql(n)}
      SELECT {COLUMNS}, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position FROM last"""


@query("w4_latest_40", _position_sql(40))
def w4_latest_40(spark, sf_dir):
    return conversations.latest_messages(views.chat(spark, sf_dir))


@query("w4_latest_3", _position_sql(3))
def w4_latest_3(spark, sf_dir):
    return conversations.latest_messages(views.chat(spark, sf_dir), 3)


def _trim_sql(kept: int) -> str:
    return f"""WITH {CHAT}, numbered AS (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS pos,
               count(*) OVER (PARTITION BY session_id) AS n FROM chat),
      starts AS (
        SELECT session_id, min(pos) AS start_pos FROM numbered
        WHERE pos > n - {kept} AND role <> 'tool' GROUP BY 1)
      SELECT {COLUMNS} FROM numbered LEFT JOIN starts USING (session_id)
      WHERE n <= {kept + 1} OR pos = 1 OR pos >= start_pos"""


@query("w5_trim_30", _trim_sql(30))
def w5_trim_30(spark, sf_dir):
    return conversations.trimmed_history(views.chat(spark, sf_dir))


@query("w5_trim_5", _trim_sql(5))
def w5_trim_5(spark, sf_dir):
    return conversations.trimmed_history(views.chat(spark, sf_dir), 5)


def _orphan_sql(n: int) -> str:
    return f"""WITH {CHAT}, {_latest_sql(n)}, starts AS (
        SELECT session_id, min(id) AS first_id FROM last WHERE NOT {ORPHAN} GROUP BY 1)
      SELECT {COLUMNS} FROM last JOIN starts USING (session_id) WHERE id >= first_id"""


@query("w6_orphan_head_40", _orphan_sql(40))
def w6_orphan_head_40(spark, sf_dir):
    return conversations.without_orphan_head(views.chat(spark, sf_dir))


@query("w6_orphan_head_3", _orphan_sql(3))
def w6_orphan_head_3(spark, sf_dir):
    return conversations.without_orphan_head(views.chat(spark, sf_dir), 3)


@query(
    "f18_replayed_messages",
    f"""WITH {CHAT}, damaged AS (
          SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN left(tool_calls, length(tool_calls) - 1) ELSE tool_calls END AS tool_calls,
                            CASE WHEN id % 4 = 0 THEN NULL ELSE content END AS content) FROM chat),
        last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM damaged QUALIFY back <= 40),
        starts AS (SELECT session_id, min(id) AS first_id FROM last WHERE NOT {ORPHAN} GROUP BY 1)
        SELECT session_id, id, role, coalesce(content, '') AS content,
               CASE WHEN json_valid(tool_calls) THEN tool_calls END AS tool_calls
        FROM last JOIN starts USING (session_id) WHERE id >= first_id""",
)
def f18_replayed_messages(spark, sf_dir):
    calls, message = F.col("tool_calls"), F.col("id")
    damaged = views.chat(spark, sf_dir).withColumns(
        {
            "tool_calls": F.when(message % 3 == 0, F.expr("left(tool_calls, length(tool_calls) - 1)")).otherwise(calls),
            "content": F.when(message % 4 != 0, F.col("content")),
        }
    )
    return conversations.replayable(damaged)


CALLS = f"""{CALL_FRAGMENTS}, calls AS (
  SELECT call_group, call_index, string_agg(fragment, '' ORDER BY seq) AS arguments,
         coalesce(arg_max(id, seq) FILTER (WHERE id IS NOT NULL), 'call_' || CAST(call_index AS VARCHAR)) AS id,
         arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name
  FROM call_fragments GROUP BY 1, 2)"""


@query("a18_assembled_calls", f"WITH {CALLS} SELECT * FROM calls")
def a18_assembled_calls(spark, sf_dir):
    return conversations.assembled_calls(views.call_fragments(spark, sf_dir))


@query(
    "f19_calls_as_json",
    f"""WITH {CALLS}, items AS (
          SELECT call_group, call_index,
                 '{{"id":' || CAST(to_json(id) AS VARCHAR) || ',"type":"function","function":{{"name":'
                 || CAST(to_json(name) AS VARCHAR) || ',"arguments":' || CAST(to_json(arguments) AS VARCHAR)
                 || '}}}}' AS item FROM calls)
        SELECT call_group, '[' || string_agg(item, ',' ORDER BY call_index) || ']' AS tool_calls
        FROM items GROUP BY 1""",
)
def f19_calls_as_json(spark, sf_dir):
    return conversations.calls_as_json(conversations.assembled_calls(views.call_fragments(spark, sf_dir)))


@query(
    "f9_extract_date",
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), ''),
              nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}', 0), ''),
              nullif(regexp_extract(text, '(19|20)[0-9]{2}', 0), '')) AS found FROM documents""",
)
def f9_extract_date(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.date_in_text(F.col("text")).alias("found"))


@query(
    "f9_dates_in_questions",
    r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') END AS found
       FROM orders""",
)
def f9_dates_in_questions(spark, sf_dir):
    key = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    month = F.date_format("o_orderdate", "yyyy-MM")
    question = (
        F.when(key == 0, F.concat(F.lit("销量 2001, "), month, F.lit(" 与 "), day))
        .when(key == 1, F.concat(F.lit("in 1999: "), month, F.lit("?")))
        .when(key == 2, F.concat(F.lit("No 12 in "), F.date_format("o_orderdate", "yyyy")))
        .otherwise("none")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.date_in_text(question).alias("found")
    )


LIMIT = 500
# One step per segment: the rest of the text after the cut, until nothing is left.
CHUNKS = f"""RECURSIVE cut AS (
  SELECT doc_id, 0 AS chunk_no, '' AS chunk, text AS rest FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, chunk_no + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT doc_id, chunk_no, rest,
           CASE WHEN length(rest) <= {LIMIT} THEN length(rest)
                WHEN last_stop >= 2 THEN last_stop ELSE {LIMIT} END AS n
    FROM (SELECT *, {LIMIT} + 2 - least(
                 CASE WHEN instr(reverse(left(rest, {LIMIT + 1})), '.') = 0 THEN {LIMIT + 2}
                      ELSE instr(reverse(left(rest, {LIMIT + 1})), '.') END,
                 CASE WHEN instr(reverse(left(rest, {LIMIT + 1})), chr(10)) = 0 THEN {LIMIT + 2}
                      ELSE instr(reverse(left(rest, {LIMIT + 1})), chr(10)) END) AS last_stop
          FROM cut WHERE rest <> '') s) t),
chunks AS (
  SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n_chunks, chunk
  FROM cut WHERE chunk_no > 0)"""


@query("f15_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, n_chunks, chunk FROM chunks")
def f15_chunks(spark, sf_dir):
    return documents.segments(table(spark, sf_dir, "documents"), limit=LIMIT)


@query(
    "a19_recombined",
    f"""WITH {CHUNKS} SELECT doc_id, regexp_replace(string_agg('第 ' || CAST(chunk_no AS VARCHAR) || ' 段总结:'
          || chr(10) || chunk || chr(10) || chr(10), '' ORDER BY chunk_no), '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g')
          AS combined FROM chunks GROUP BY doc_id""",
)
def a19_recombined(spark, sf_dir):
    return documents.recombined(documents.segments(table(spark, sf_dir, "documents"), limit=LIMIT))
