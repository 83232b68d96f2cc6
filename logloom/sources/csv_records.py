"""CSV records with line breaks inside quotes, read by many tasks per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.numbering import cut_lineage
from logloom.sources.lines import BROADCAST_SPLITS, scan_columns

_PIECE = "file string, block bigint, seq bigint, head boolean, open boolean, text string"


def _closed(line: str, at: int) -> int:
    """Where a quoted value that goes on at ``at`` ends (at a comma or the end of the line); -1 if it does not."""
    while True:
        quote = line.find('"', at)
        if quote < 0:
            return -1
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        after = quote + 1
        while after < len(line) and line[after] in " \t":
            after += 1
        if after == len(line) or line[after] == ",":
            return after
        comma = line.find(",", after)  # a stray quote: the value goes to the next comma as it stands
        return len(line) if comma < 0 else comma


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line, given whether one was at its start."""
    if '"' not in line:
        return inside
    line = line.removesuffix("\r")
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at = _closed(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
        else:
            at = line.find(",", at)
        if at < 0 or at >= len(line):
            return False
        at += 1  # behind the comma


def _splits(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, bool, list[tuple]]]:
    """Rows by (file, block), in order; whether the rows are the first of theirs."""
    now = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block", *columns)), strict=True))
        at = 0
        while at < len(rows):
            key, stop = rows[at][:2], at
            while stop < len(rows) and rows[stop][:2] == key:
                stop += 1
            yield key, key != now, [r[2:] for r in rows[at:stop]]
            now, at = key, stop


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether a value is open at its end if none was at its start, and if one was."""
    out: dict[tuple, list[bool]] = {}
    for key, _, rows in _splits(batches, "quoted"):
        state = out.setdefault(key, [False, True])
        for (line,) in rows:
            if line is not None:
                state[:] = [ends_inside(line, s) for s in state]
    yield pa.RecordBatch.from_pylist(
        [{"file": f, "block": b, "outside": s[0], "inside": s[1]} for (f, b), s in out.items()],
        pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]),
    )


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """Whether a value is open at the start of each split of one file."""
    splits, state, out = splits.sort_values("block", ignore_index=True), False, []
    for outside, inside in zip(splits["outside"], splits["inside"], strict=True):
        out.append(state)
        state = bool(inside if state else outside)
    return pd.DataFrame({"file": splits["file"], "block": splits["block"], "starts_inside": out})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split; the end of one that began before (``head``) and one that is not ended (``open``) are pieces."""
    key, seq, lines, head, inside = None, 0, [], False, False
    rows: list[tuple] = []

    def last() -> list[tuple]:
        return [(*key, seq, head, True, "\n".join(lines))] if lines else []

    for at, first, values in _splits(batches, "value", "starts_inside"):
        if first:
            rows += last()
            key, seq, lines, inside = at, 0, [], values[0][1]
            head = inside
        for value, _ in values:
            if not lines:
                if not inside and not value.removesuffix("\r"):
                    continue
                if not head:
                    seq += 1
            lines.append(value)
            inside = ends_inside(value, inside)
            if not inside:
                rows.append((*key, seq, head, False, "\n".join(lines)))
                lines, head = [], False
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    rows += last()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_()), ("text", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def csv_records(spark: SparkSession, files) -> DataFrame:
    """``(file, number, text)`` of every record of CSV files, the header among them; blank lines outside quotes are none.

    ``number`` runs on from file to file in path order. A first pass tells for each split how it
    changes whether a value in quotes is open, a running state over the splits of a file (one row each) tells how each begins, and the
    second pass puts the lines of a record together. Only what a split border cuts is put together
    by a shuffle. A quote opens a value at its start only, as CSV readers see it; one inside a plain value is text.
    """
    scan = spark.read.text(files, lineSep="\n").select("value", *scan_columns())
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value")).alias("quoted")
    changes = scan.select("file", "block", quoted).mapInArrow(_changes, "file string, block bigint, outside boolean, inside boolean")
    starts = cut_lineage(changes.groupBy("file").applyInPandas(_starts, "file string, block bigint, starts_inside boolean"), "starts")
    few = starts.count() <= BROADCAST_SPLITS
    told = scan.join(F.broadcast(starts) if few else starts, ["file", "block"])
    if not few:  # a shuffle loses the order of lines
        told = told.sortWithinPartitions("file", "block", "mid")
    pieces = cut_lineage(told.select("file", "block", "value", "starts_inside").mapInArrow(_pieces, _PIECE), "pieces")
    counts = pieces.groupBy("file", "block").agg(F.count_if(~F.col("head")).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = pieces.join(F.broadcast(offsets) if few else offsets, ["file", "block"])
    numbered = numbered.withColumn("number", F.col("offset") + F.when(F.col("head"), 0).otherwise(F.col("seq")))
    cut = F.col("head") | F.col("open")
    parts = numbered.filter(cut).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    mended = parts.select("file", "number", F.array_join("parts.text", "\n").alias("text"))
    return numbered.filter(~cut).select("file", "number", "text").unionByName(mended)
