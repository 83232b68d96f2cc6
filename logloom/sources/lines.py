"""Text lines with their 1-based line number, without a global sort."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import strip
from logloom.operators.numbering import cut_lineage


def scan_columns():
    """Where a row lies in the file scan; select these directly on the scan."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    ]


# Splits whose offsets are sent to every task at most; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000


def number_rows(scan: DataFrame, per_file: bool = False) -> DataFrame:
    """Add ``line`` (1-based, in file order) to a file scan with ``scan_columns``.

    Each file split counts its rows, a running sum over the splits (one row per
    split, stored) gives the offsets, and each row adds its position inside the split. The
    scan runs twice, under the same splits. Up to ``BROADCAST_SPLITS`` splits the offsets
    go to the rows, and the text is neither sorted nor shuffled; a table of more splits
    is joined on the split. The numbers run on from file to file in path order, or
    start anew in each file with ``per_file=True``.
    """
    return number_scans([scan], per_file)[0]


def number_scans(scans: list[DataFrame], per_file: bool = False) -> list[DataFrame]:
    """The same for scans of different files under one numbering."""
    counts = [scan.groupBy("file", "block").agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n")) for scan in scans]
    splits = counts[0]
    for more in counts[1:]:
        splits = splits.unionByName(more)
    by = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        splits.select("file", "block", "first_mid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "splits"
    )
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    line = (F.col("mid") - F.col("first_mid") + F.col("offset") + 1).alias("line")
    return [scan.join(offsets, ["file", "block"]).select(line, *[c for c in scan.columns if c not in ("file", "block", "mid")], "file") for scan in scans]


def read_lines(spark: SparkSession, paths, per_file: bool = False) -> DataFrame:
    """``(line, text, file)`` for every non-blank line of ``paths`` (one or a list of files, folders, globs).

    Blank lines count but are not returned; outer white space is dropped. ``line`` is unique over
    all files unless ``per_file``.
    """
    scan = spark.read.text(paths).select(F.col("value"), *scan_columns())
    return (
        number_rows(scan, per_file)
        .select("line", strip(F.col("value")).alias("text"), "file")
        .filter(F.col("text") != "")
    )


def files_of(spark: SparkSession, paths) -> list[str]:
    """The files of ``paths`` in path order, as names that can be read again, whatever characters they hold."""
    listed = spark.read.text(paths).inputFiles()  # as encoded URIs
    return sorted(re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri)) for uri in listed)


def plain_path(uri: str) -> str:
    """A URI with one slash after its scheme, as paths are written in either way."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def first_lines(spark: SparkSession, paths, count: int) -> DataFrame:
    """``(line, text)`` of the first ``count`` lines of the first file in path order that has a line with text.

    Only rows of a file's first split are taken, in their order; a file of many splits is not read on. Files
    without a byte are passed over by their size, in one listing.
    """
    files, rows = files_of(spark, paths), []
    if len(files) > 1:
        sizes = spark.read.format("binaryFile").load(files).select("path", "length").filter("length > 0")
        some = {plain_path(r["path"]) for r in sizes.select("path").collect()}
        files = [f for f in files if plain_path(re.sub(r"\\(.)", r"\1", f)) in some]
    for file in files:
        head = spark.read.text(file).select("value", *scan_columns()).filter(F.col("block") == 0)
        rows = sorted(head.select("mid", "value").limit(count).collect())
        if any(r["value"].strip() for r in rows):
            break
    return spark.createDataFrame([(i + 1, r["value"]) for i, r in enumerate(rows)], "line bigint, text string")
