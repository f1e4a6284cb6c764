"""File names, paths, hosts, keys and time stamps."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from forecourt.functions.text import java_trim

# Zone folders, default endpoint and stamp formats of the platform.
ORIGINAL_ZONE = "/original_data"
PROCESSED_ZONE = "/processed_data"
DEFAULT_HOST = "127.0.0.1"
DEFAULT_PORT = 9999
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FILE_STAMP = "yyyyMMdd_HHmmss"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """Text after the last dot, '' without a dot or after a trailing dot."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def file_type(name: Column) -> Column:
    return F.upper(extension(name))


def base_name(name: Column) -> Column:
    """Text before the last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def in_zone(path: Column, zone: str) -> Column:
    """True for the zone folder itself and everything below it."""
    return path.rlike(f"^{zone}(/.*)?$")


def decoded_name(c: Column) -> Column:
    """Percent-decoded UTF-8 name; NULL when the escapes are malformed."""
    return F.try_url_decode(c)


def _address(c: Column) -> Column:
    without_scheme = F.regexp_replace(java_trim(c), r"^.*?://", "")
    return F.regexp_extract(without_scheme, r"^([^/]*)", 1)


def host(c: Column) -> Column:
    """Host of ``scheme://host:port/path``; empty text means the local default."""
    address = _address(c)
    named = F.regexp_extract(address, r"^(.+):[^:]*$", 1)
    found = F.when(named != "", named).when(address != "", address)
    return F.coalesce(found, F.lit(DEFAULT_HOST))


def port(c: Column, default: int = DEFAULT_PORT) -> Column:
    """Port after the last colon; missing or malformed ports give the default."""
    digits = F.regexp_extract(_address(c), r"^.+:([+-]?\d+)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(default))


def socket_host(c: Column) -> Column:
    """Device address of a ``ws://``/``wss://`` URL: everything before the first colon."""
    return F.substring_index(F.regexp_replace(c, "wss?://", ""), ":", 1)


def dots_to_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("_"))


def safe_label(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def safe_task_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a timestamp; the session time zone must be UTC."""
    return F.date_format(ts, ISO_UTC)


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, FILE_STAMP)


def result_label(operation: str, field: Column, millis: Column) -> Column:
    return F.concat_ws("_", F.lit(operation), safe_label(field), F.concat(millis.cast("string"), F.lit(".csv")))


def result_path(folder: str, operation: str, field: str, millis: int) -> str:
    """Where a job's result goes: ``<operation>_<field>_<millis>.csv``, other characters as ``_``."""
    label = re.sub("[^a-zA-Z0-9]", "_", field)
    return f"{folder.rstrip('/')}/{operation}_{label}_{millis}.csv"
