"""Text lines to entries: syslog shape and servicing-log shape.

Both are one projection, so they run on any DataFrame with ``line`` and ``text``.
A line that does not match keeps its whole text as the message, at level Info,
with no timestamp, component or pid.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import patterns as P
from logloom.functions.severity import infer_level
from logloom.functions.text import match_groups, split_groups, strip
from logloom.schema import as_entries

# month names as they appear in syslog lines
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def make_timestamp(year: Column, month: Column, day: Column, time: Column) -> Column:
    """Zone-less timestamp from its parts and ``HH:mm:ss``; null if they name no instant."""
    part = lambda i: F.substring(time, 1 + 3 * i, 2).try_cast("int")
    second = part(2)
    return F.when(
        second < 60,
        F.try_make_timestamp_ntz(
            year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), part(0), part(1), second.cast("decimal(16,6)")
        ),
    )


def month_number(name: Column) -> Column:
    months = F.create_map(*[F.lit(v) for i, month in enumerate(_MONTHS, 1) for v in (month, i)])
    return F.element_at(months, F.lower(name))


def _entries(df: DataFrame, source: str, level: Column) -> DataFrame:
    matched = F.col("matched")
    return as_entries(
        df.select(
            "timestamp",
            F.when(matched, level).otherwise("Info").alias("level"),
            "component",
            "message_raw",
            "pid",
            F.lit(source).alias("source"),
            "line",
        )
    )


def _fields(lines: DataFrame, pattern: str, n: int, timestamp: Column, **parts: Column) -> DataFrame:
    # Step by step: a projection whose columns are used several times is kept apart by
    # the optimizer, so the regex and the strip run once per line.
    once = lines.select("line", "text", split_groups(F.col("text"), pattern, n).alias("once"))
    groups = once.select("line", "text", match_groups(F.col("text"), pattern, n, F.col("once")).alias("g"))
    matched = F.col("g").isNotNull()
    return groups.select(
        "line",
        matched.alias("matched"),
        F.when(matched, timestamp).alias("timestamp"),
        F.when(matched, strip(F.col("g")[n - 1])).otherwise(F.col("text")).alias("message_raw"),
        *[F.when(matched, c).otherwise("").alias(name) for name, c in parts.items()],
    )


def parse_syslog(lines: DataFrame, year: int | None = None, strict_leap_day: bool = False, ruleset: str = "current") -> DataFrame:
    """Entries from ``Mon D hh:mm:ss host program[pid]: message`` lines.

    The shape has no year; ``year`` defaults to the current one. ``strict_leap_day``
    turns February 29 into null, as a parser that fixes the year afterwards does.
    Store the result before analysing it: filters on parsed columns would otherwise
    be pushed below the parse and repeat it.
    """
    g = F.col("g")
    month = month_number(g[0])
    stamp = make_timestamp(F.lit(year or dt.date.today().year), month, g[1], g[2])
    if strict_leap_day:
        stamp = F.when((month != 2) | (g[1].try_cast("int") != 29), stamp)
    df = _fields(lines, P.SYSLOG, 7, stamp, component=g[4], pid=g[5])
    return _entries(df, "linux", infer_level(F.col("message_raw"), F.col("component"), ruleset))


def parse_servicing(lines: DataFrame, ruleset: str = "current") -> DataFrame:
    """Entries from ``YYYY-MM-DD hh:mm:ss, Level Component message`` lines.

    The level word of the line stands unless the message reads as Error or Warning.
    """
    g = F.col("g")
    stamp = make_timestamp(F.substring(g[0], 1, 4), F.substring(g[0], 6, 2), F.substring(g[0], 9, 2), g[1])
    df = _fields(lines, P.SERVICING, 5, stamp, word=g[2], component=g[3], pid=F.lit(""))
    df = df.withColumn("inferred", infer_level(F.col("message_raw"), F.col("component"), ruleset))
    level = F.when(F.col("inferred").isin("Error", "Warning"), F.col("inferred")).otherwise(F.col("word"))
    return _entries(df, "windows", level)
