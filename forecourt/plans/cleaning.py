"""Deduplicating files, counting words, and jobs over a whole zone."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.functions import names
from forecourt.operators import dedup, words
from forecourt.sinks import files as sinks
from forecourt.sources import files as sources
from forecourt.sources.catalog import has_files
from forecourt.workspace import file_system, remove


# Fixed value: what a job on an empty zone answers.
EMPTY_ZONE = "HDFS %s 下没有数据文件，无法提交计算作业。请先上传数据或执行一次数据采集。"


def _read(
    spark: SparkSession, path: str, charset: str | None, schema: str | None, infer: bool
) -> DataFrame:
    """A file as the cleaning tasks see it.

    Values are compared and printed by their types (``1.50`` is 1.5), which are inferred
    unless a schema is given.  Finding the charset and the types of a CSV takes a pass over
    the file each; name both where they are known.
    """
    if charset is None:
        charset = sources.charset_of(spark, path) if sources.file_kind(path) == "csv" else "UTF-8"
    return sources.read_by_extension(spark, path, charset=charset, infer=infer, schema=schema)


def deduplicate_file(
    spark: SparkSession,
    path: str,
    fields: str,
    folder: str,
    single_file: bool = False,
    charset: str | None = None,
    schema: str | None = None,
    infer: bool = True,
) -> str:
    """Write ``deduplicated_<name>`` of a CSV (by column names) or TXT (by positions)."""
    out = sinks.dedup_path(folder, path)
    df = _read(spark, path, charset, schema, infer)
    if sources.file_kind(path) == "csv":
        sinks.write_csv(dedup.dedup_columns(df, fields), out, single_file)
    else:
        sinks.write_lines(dedup.dedup_lines(df, fields), out, single_file)
    return out


def file_groups(
    spark: SparkSession, paths: Sequence[str], charset: str | None = None, schema: str | None = None
) -> list[tuple[str, str, list[str]]]:
    """The paths as ``(kind, charset, paths)``: what one reader can scan together.

    Text files are one group, CSV files one per charset and header, found for all of them in
    one job; with a charset and a schema given no job is needed.  A path whose files differ
    is an error; plain ASCII files in a folder agree with any charset.
    """
    if not paths:
        raise ValueError("no files given")
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(sources.file_kind(path), []).append(path)
    if set(kinds) - {"csv", "txt"}:
        raise ValueError(f"unsupported file format: {sorted(set(kinds) - {'csv', 'txt'})}")
    groups = [("txt", "UTF-8", kinds["txt"])] if "txt" in kinds else []
    csv = kinds.get("csv", [])
    if csv and charset and schema:
        groups.append(("csv", charset, csv))
    elif csv:
        found = sources.given_paths(spark, sources.described_files(spark, csv), csv)
        looks = {}
        for r in found.select("given", "charset", "plain", F.hex("header").alias("header")).distinct().collect():
            looks.setdefault(r["given"], []).append(r)
        by_look: dict[tuple[str, str], list[str]] = {}
        for i, path in enumerate(csv):
            mine = looks.get(i, [])
            charsets = {charset} if charset else sources.common_charsets((r["charset"], r["plain"]) for r in mine)
            headers = {r["header"] for r in mine}
            if len(charsets) > 1 or len(headers) > 1:
                raise ValueError(f"files under {path} have different charsets or headers")
            look = next(iter(charsets), "UTF-8"), next(iter(headers), "")
            by_look.setdefault(look, []).append(path)
        groups += [("csv", look[0], members) for look, members in by_look.items()]
    return groups


def _read_group(spark: SparkSession, kind: str, charset: str, paths: list[str], schema: str | None, infer: bool) -> DataFrame:
    if kind == "csv":
        return sources.read_csv(spark, paths, schema=schema, charset=charset, infer=infer)
    return sources.read_lines(spark, paths)


def deduplicate_files(
    spark: SparkSession,
    paths: Sequence[str],
    fields: str,
    folder: str,
    single_file: bool = False,
    charset: str | None = None,
    schema: str | None = None,
    infer: bool = True,
) -> list[str]:
    """``deduplicated_<name>`` of every file, each by itself, from one scan per group of files.

    Files of one group are typed together, deduplicated by file and fields, written with a
    folder per file, and the folders renamed.  A small file is one part file, a large one
    several.  Returns where they are, in the order given.  A target that exists, or two of
    one name, is an error before anything is written.
    """
    outs = [sinks.dedup_path(folder, p) for p in paths]
    for out in outs:  # before anything is moved
        system, target = file_system(spark, out)
        if system.exists(target):
            raise FileExistsError(target.toString())
    if len(set(outs)) < len(outs):
        raise FileExistsError("two files would have one name")
    for kind, found, members in file_groups(spark, paths, charset, schema):
        df = _read_group(spark, kind, found, members, schema, infer)
        columns = df.columns
        df = df.select("*", F.col("_metadata.file_path").alias("_path"))
        files = df.select(F.col("_path").alias("path")).distinct()
        placed = sources.given_paths(spark, files, members).withColumnRenamed("path", "_path")
        df = df.join(placed, "_path").select(*[F.col(f"`{c}`") for c in columns], "given")
        if kind == "csv":
            rows = dedup.dedup_columns(df, fields if fields == dedup.ALL_FIELDS else f"given,{fields}")
        else:
            rows = dedup.dedup_lines(df, fields, ["given"])
        # Without this every task that has rows of a file writes a part of it.  Rebalancing gathers a
        # file's rows, and several small files, in one task, and splits what is too large for one.
        rows = rows.repartition("given") if single_file else rows.hint("rebalance", "given")
        work = f"{folder.rstrip('/')}/_deduplicating-{uuid.uuid4().hex[:12]}"
        writer = rows.write.partitionBy("given")
        if kind == "csv":
            writer.options(header=True, encoding="UTF-8", **sinks.TIME_FORMATS).csv(work)
        else:
            writer.text(work)
        system, _ = file_system(spark, work)
        for i, path in enumerate(members):
            made, target = (file_system(spark, p)[1] for p in (f"{work}/given={i}", sinks.dedup_path(folder, path)))
            if system.exists(made):
                system.rename(made, target)
            else:
                system.mkdirs(target)  # the file had no rows
        remove(spark, work)
    return outs


def field_columns(df: DataFrame, fields: str, kind: str):
    """Chosen columns of a CSV by name, or of text lines by position."""
    if kind == "csv":
        return {f: F.col(f"`{f}`") for f in fields.split(",")}
    return {
        f: sources.field_at(F.col("value"), p) for f, p in zip(fields.split(","), sources.positions(fields))
    }


def count_file_words(
    spark: SparkSession,
    paths: Sequence[str],
    fields: str,
    out: str | None = None,
    charset: str | None = None,
    schema: str | None = None,
    infer: bool = True,
) -> DataFrame:
    """Word frequency of chosen fields over all files; optionally written.

    The files are read in groups (see ``file_groups``), so the plan grows with the number of
    different headers and charsets, not of files.
    """
    values = []
    for kind, found, members in file_groups(spark, paths, charset, schema):
        df = _read_group(spark, kind, found, members, schema, infer)
        values.append(words.field_values(df, field_columns(df, fields, kind)))
    freq = words.count_field_words(reduce(DataFrame.unionByName, values))
    if out:
        sinks.write_word_frequency(freq, out)
    return freq


def save_result(df: DataFrame, folder: str, operation: str, field: str) -> str:
    """Write a job's result as CSV under a name that tells the job, the field and the time."""
    out = names.result_path(folder, operation, field, time.time_ns() // 1_000_000)
    sinks.write_csv(df, out)
    return out


def zone_job(spark: SparkSession, folder: str | Sequence[str], job_type: str) -> DataFrame:
    """``dedup``: distinct lines of all files of a zone; any other type: token counts.

    A zone without files is an error with the platform's message.
    """
    folders = [folder] if isinstance(folder, str) else list(folder)
    if not any(has_files(spark, f) for f in folders):
        raise FileNotFoundError(EMPTY_ZONE % ", ".join(folders))
    lines = sources.read_lines(spark, folder)
    if job_type is not None and job_type.lower() == "dedup":
        return dedup.distinct_rows(lines.select("value"))
    return words.token_count(lines)
