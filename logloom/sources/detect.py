"""Which format a log has, from its name and its first lines."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import patterns as P
from logloom.functions.text import strip
from logloom.sources.lines import files_of, first_lines, read_lines
from logloom.sources.parsers import parse_servicing, parse_syslog
from logloom.sources.tables import read_csv

SAMPLE_LINES = 50


def score_format(lines: DataFrame, ruleset: str = "current") -> DataFrame:
    """One row ``(syslog_hits, servicing_hits, format)`` from the first 50 lines.

    More syslog hits than servicing hits mean syslog, any servicing hit servicing.
    Without a hit, words of the first 30 lines decide, and servicing is the
    default. The ``legacy`` ruleset asks for a strict majority, then looks for an
    ISO date with a comma or a syslog line start in the first 20 lines, and says
    ``unknown`` otherwise.
    """
    head = lines.select("line", strip(F.col("text")).alias("text")).orderBy("line").limit(SAMPLE_LINES)
    syslog, servicing = F.col("text").rlike(P.SYSLOG), F.col("text").rlike(P.SERVICING)
    early = lambda n, cond: F.coalesce(F.bool_or((F.col("line") <= n) & cond), F.lit(False))
    has_any = lambda words: F.greatest(*[F.contains("text", F.lit(w)) for w in words], F.lit(False))
    legacy = ruleset == "legacy"
    scored = head.agg(
        F.count_if(syslog).alias("syslog_hits"),
        F.count_if(servicing & ~syslog if legacy else servicing).alias("servicing_hits"),
        early(30, has_any(P.SYSLOG_HINTS)).alias("syslog_words"),
        early(30, has_any(P.SERVICING_HINTS)).alias("servicing_words"),
        early(20, F.contains("text", F.lit(","))).alias("comma"),
        early(20, F.col("text").rlike(r"(?U)\d{4}-\d{2}-\d{2}")).alias("iso_date"),
        early(20, F.col("text").rlike(P.SYSLOG_PREFIX)).alias("syslog_start"),
    )
    a, b = F.col("syslog_hits"), F.col("servicing_hits")
    if legacy:
        fmt = F.when(a > b, "syslog").when(b > a, "servicing")
        fmt = fmt.when(F.col("comma") & F.col("iso_date"), "servicing")
        fmt = fmt.when(F.col("syslog_start"), "syslog").otherwise("unknown")
    else:
        fmt = F.when(a > b, "syslog").when(b > 0, "servicing")
        fmt = fmt.when(F.col("syslog_words"), "syslog").otherwise("servicing")
    return scored.select("syslog_hits", "servicing_hits", fmt.alias("format"))


def suffix_of(spark: SparkSession, paths: str | list[str]) -> str:
    """The lower-case file suffix of ``paths``; of a folder or glob, that of its first file."""
    first = paths if isinstance(paths, str) else paths[0]
    own = os.path.splitext(first.rstrip("/"))[1].lower()
    if own and not any(c in own for c in "*?{["):
        return own
    files = files_of(spark, paths)
    return os.path.splitext(files[0])[1].lower() if files else own


def detect_format(spark: SparkSession, paths: str | list[str], ruleset: str = "current") -> str:
    """``csv`` by file name, else the scored format; of several files the first in path order that has text decides, by its first 50 lines."""
    if suffix_of(spark, paths) == ".csv":
        return "csv"
    return score_format(first_lines(spark, paths, SAMPLE_LINES), ruleset).first()["format"]


def read_entries(
    spark: SparkSession,
    path: str | list[str],
    year: int | None = None,
    ruleset: str = "current",
    on_unknown: str | None = None,
    readers: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None,
    **options,
) -> DataFrame:
    """Entries of a log of any known format: a file, a folder, a glob, or a list of them.

    ``line`` runs on from file to file in path order, so it is unique. ``readers`` adds formats: a function from (session, path) to entries for each
    lower-case file suffix, tried before detection. The ``legacy`` ruleset raises
    on an unknown format unless ``on_unknown='servicing'``, and takes a CSV without
    rows for plain lines.
    """
    return read_numbered(spark, path, year, ruleset, on_unknown, readers, **options)[0]


def read_numbered(spark, path, year=None, ruleset="current", on_unknown=None, readers=None, **options) -> tuple[DataFrame, bool]:
    """The entries of :func:`read_entries`, and whether their lines were numbered here, so cannot repeat."""
    suffix = suffix_of(spark, path)
    if readers and suffix in readers:
        return readers[suffix](spark, path), False
    fmt = detect_format(spark, path, ruleset)
    if fmt == "csv":
        entries = read_csv(spark, path, year, ruleset, **options)
        if ruleset != "legacy" or not entries.isEmpty():
            return entries, False
        fmt = score_format(first_lines(spark, path, SAMPLE_LINES), ruleset).first()["format"]
    if fmt == "unknown":
        if on_unknown != "servicing":
            raise ValueError(f"unknown log format: {path}")
        fmt = "servicing"
    lines = read_lines(spark, path)
    if fmt == "syslog":
        return parse_syslog(lines, year, ruleset=ruleset), True
    return parse_servicing(lines, ruleset), True
