"""Chat logs: display, trimming, restoring, tool-call assembly.

Messages are rows with ``session_id``, ``id`` (ascending in time), ``role``, ``content``
and ``tool_calls``.  A session may hold any number of messages; every window below runs
on rows already cut to a fixed number per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from forecourt.functions.text import is_blank
from forecourt.operators.ranking import last_per_key

# History lengths of the platform.
RESTORED_MESSAGES = 40
KEPT_MESSAGES = 30


def _has_calls():
    return F.col("tool_calls").isNotNull() & (F.col("tool_calls") != "")


def displayable(messages: DataFrame) -> DataFrame:
    """User and assistant texts; no tool-calling answers, no blank texts."""
    shown = F.col("role").isin("user", "assistant")
    calling = (F.col("role") == "assistant") & _has_calls()
    return messages.filter(shown & ~calling & ~is_blank(F.col("content")))


def latest_messages(messages: DataFrame, n: int = RESTORED_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every session; ``position`` counts from the oldest."""
    last = last_per_key(messages, ["session_id"], [F.col("id").desc()], n)
    in_session = Window.partitionBy("session_id")
    return last.withColumn(
        "position", F.count("*").over(in_session) - F.col("back") + 1
    ).drop("back")


def trimmed_history(messages: DataFrame, kept: int = KEPT_MESSAGES) -> DataFrame:
    """Sessions longer than ``kept + 1`` shrink to their first message and the last ``kept``.

    Leading ``tool`` rows of that tail go too, so no tool result stays without its call.
    Only ``kept + 2`` last rows and one first row per session and task are shuffled.
    """
    tail = last_per_key(messages, ["session_id"], [F.col("id").desc()], kept + 2)
    head = last_per_key(messages, ["session_id"], [F.col("id").asc()], 1)
    rows = tail.withColumn("_head", F.lit(False)).unionByName(head.withColumn("_head", F.lit(True)))
    in_session = Window.partitionBy("session_id")
    so_far = in_session.orderBy("id", "_head").rowsBetween(Window.unboundedPreceding, 0)
    in_tail = ~F.col("_head") & (F.col("back") <= kept)
    long_session = F.count_if(~F.col("_head")).over(in_session) > kept + 1
    started = F.max(F.when(in_tail & (F.col("role") != "tool"), 1)).over(so_far).isNotNull()
    keep = F.when(
        F.col("_long"), F.col("_head") | (in_tail & F.col("_started"))
    ).otherwise(~F.col("_head"))
    return (
        rows.withColumns({"_long": long_session, "_started": started})
        .filter(keep)
        .drop("_long", "_started", "_head", "back")
    )


def without_orphan_head(messages: DataFrame, n: int = RESTORED_MESSAGES) -> DataFrame:
    """The last ``n`` messages without leading tool results or tool-calling answers."""
    orphan = (F.col("role") == "tool") | ((F.col("role") == "assistant") & _has_calls())
    so_far = (
        Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = last_per_key(messages, ["session_id"], [F.col("id").desc()], n)
    return (
        last.withColumn("_open", F.max(F.when(~orphan, 1)).over(so_far))
        .filter("_open = 1")
        .drop("_open", "back")
    )


def replayable(messages: DataFrame, n: int = RESTORED_MESSAGES) -> DataFrame:
    """A restored session as it is sent again: no orphan head, no NULL texts, valid calls.

    Stored calls that are blank or not JSON are left out; the message itself stays.
    """
    valid = _has_calls() & F.try_parse_json(F.col("tool_calls")).isNotNull()
    return without_orphan_head(messages, n).withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            "tool_calls": F.when(valid, F.col("tool_calls")),
        }
    )


def assembled_calls(fragments: DataFrame) -> DataFrame:
    """Tool calls from streamed pieces ``(call_group, call_index, seq, id, name, fragment)``.

    Pieces are concatenated in arrival order; the last id and name win.  A call without an
    id gets one from its index.
    """
    pieces = F.array_sort(F.collect_list(F.struct("seq", "fragment")))
    return fragments.groupBy("call_group", "call_index").agg(
        F.array_join(F.transform(pieces, lambda p: p["fragment"]), "").alias("arguments"),
        F.coalesce(
            F.max_by("id", F.when(F.col("id").isNotNull(), F.col("seq"))),
            F.concat(F.lit("call_"), F.col("call_index").cast("string")),
        ).alias("id"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"),
    )


def calls_as_json(calls: DataFrame) -> DataFrame:
    """One JSON array of function calls per group, in call order; no arguments give ``{}``."""
    arguments = F.when(F.col("arguments") == "", F.lit("{}")).otherwise(F.col("arguments"))
    call = F.struct(
        F.col("id"),
        F.lit("function").alias("type"),
        F.struct(F.col("name"), arguments.alias("arguments")).alias("function"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("call_index"), call.alias("call"))))
    return calls.groupBy("call_group").agg(
        F.to_json(F.transform(ordered, lambda c: c["call"])).alias("tool_calls")
    )
