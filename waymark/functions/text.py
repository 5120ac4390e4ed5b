"""Parsing and formatting expressions of the text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(line: Column) -> Column:
    """The numbers of a line split at white space, commas or semicolons; a field that is no number is null."""
    return F.transform(F.split(F.trim(line), r"[\s,;]+"), lambda s: s.try_cast("double"))


def well_formed(values: Column, n: int) -> Column:
    return (F.size(values) == n) & ~F.exists(values, lambda v: v.isNull())


def calibration(line: Column, key: str) -> Column:
    """The twelve numbers behind ``key:``, else null."""
    values = numbers(F.regexp_extract(line, rf"^{key}:\s*(.*)$", 1))
    return F.when(line.rlike(rf"^{key}:") & well_formed(values, 12), values)


def datetime_ns(text: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss.nnnnnnnnn`` (UTC) as nanoseconds since the epoch; null if it doesn't read so."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,9}\s*$")
    # days and seconds of the day, so that the session's time zone has no part in it
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("long") * 86_400
    clock = F.substring(text, 12, 2).try_cast("long") * 3600 + F.substring(text, 15, 2).try_cast("long") * 60 + F.substring(text, 18, 2).try_cast("long")
    seconds = day + clock
    rest = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    return F.when(ok, seconds * F.lit(1_000_000_000).cast("long") + rest)


def file_stamp_ns(path: Column) -> Column:
    """Nanoseconds of a file named by them."""
    return F.regexp_extract(path, r"(\d+)\.[A-Za-z0-9]+$", 1).try_cast("long")


def seconds_to_ns(t: Column) -> Column:
    return F.round(t * 1e9).cast("long")


def ns_to_seconds(t: Column) -> Column:
    return t / F.lit(1e9)


def ns_to_timestamp(t: Column) -> Column:
    """Microsecond timestamp; the last three digits are lost."""
    return F.timestamp_micros(F.floor(t / 1000))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp column (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def progress(step: Column, of: Column) -> Column:
    return F.format_string("Timestep: %d / %d (%.02f%%)", step, of, 100.0 * step / of)


def strip_line_ends(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\r\n]", ""))


def split_default(s: Column) -> Column:
    """struct<name, fallback> of ``name|fallback``, split at the first bar; the fallback is null without one."""
    at = F.instr(s, "|")
    return F.struct(F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(s).alias("name"), F.when(at > 0, F.substr(s, at + 1)).alias("fallback"))


def saturate(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
