"""Distributed least-significant-digit radix sort: positions by counting, not by comparing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.numbering import cut_lineage

# Bits of a digit, and consecutive positions that one task places at a time.
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 15


def sorted_positions(df: DataFrame, keys: list[str], *, digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``position`` = 0, 1, … in ascending order of the whole-number columns ``keys``.

    Every pass is a stable counting sort by one digit: blocks of consecutive positions count
    their digits, running sums over (digit, block) give each block the place where its rows of
    a digit begin, and the rows of a block follow one another from there. Positions are numbers,
    so a digit or key that most rows share spreads over as many blocks as any other. The digits a
    key needs follow from its least and largest value. Rows are written once a pass. Keys may not
    be null; equal rows get neighbouring positions in no particular order. An empty table gives
    an empty result; ``position`` and names with a leading underscore are taken.
    """
    spark = df.sparkSession
    out_columns = [*df.columns, "position"]
    rows = cut_lineage(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "unsorted")
    sides = [f(k).cast("decimal(20,0)").alias(f"{side}_{i}") for i, k in enumerate(keys) for side, f in (("low", F.min), ("high", F.max))]
    ends = rows.agg(*sides).first()
    if ends["low_0"] is None:
        return spark.createDataFrame([], df.schema).withColumn("position", F.lit(0).cast("bigint"))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_least"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(parts.select("_part", (before - F.col("_least")).alias("_before")), "_part")
    rows = rows.select(*df.columns, (F.col("_at") + F.col("_before")).cast("bigint").alias("position"))
    for i in reversed(range(len(keys))):
        low, high = int(ends[f"low_{i}"]), int(ends[f"high_{i}"])
        if high - low < 1 << 63:
            key, width = F.col(keys[i]).cast("bigint") - F.lit(low), (high - low).bit_length()
        else:  # the difference has no signed form; with the sign bit turned, digits ascend all the same
            key, width = F.col(keys[i]).cast("bigint").bitwiseXOR(F.lit(-(1 << 63))), 64
        for shift in range(0, width, digit_bits):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int")
            rows = cut_lineage(_counting_pass(rows, digit, 1 << digit_bits, block_rows), "sorted")
    return rows.select(*out_columns)


def _counting_pass(rows: DataFrame, digit: F.Column, values: int, block_rows: int) -> DataFrame:
    """``rows`` with the positions they have in the stable order of ``digit``."""
    told = rows.withColumns({"_digit": digit, "_block": F.expr(f"position div {block_rows}")})
    counts = told.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("_digit", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_within"))
    # One row for each value of a digit: ``values`` at most, whatever the table.
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_digit").agg(F.sum("_rows").alias("_rows"))
    totals = totals.select("_digit", F.coalesce(F.sum("_rows").over(smaller), F.lit(0)).alias("_smaller"))
    begin = (F.col("_within") + F.col("_smaller")).alias("_begin")
    # New names: the two sides of a cogroup may not share columns.
    begins = within.join(F.broadcast(totals), "_digit").select(F.col("_block").alias("_begin_block"), F.col("_digit").alias("_begin_digit"), begin)

    def place(block: pa.Table, begin: pa.Table) -> pa.Table:
        position = block.column("position").to_numpy()
        order = np.empty(len(position), np.int64)  # positions of a block follow one another
        order[position - position.min()] = np.arange(len(position))
        digits = block.column("_digit").to_numpy()[order].astype(np.uint16 if values <= 1 << 16 else np.int64)
        seen = np.bincount(digits, minlength=values)
        start = np.zeros(values, np.int64)
        start[begin.column("_begin_digit").to_numpy()] = begin.column("_begin").to_numpy()
        # A stable sort of small whole numbers is a counting sort in numpy.
        placed = np.argsort(digits, kind="stable")
        new = np.empty(len(order), np.int64)
        new[order[placed]] = np.repeat(start - (np.cumsum(seen) - seen), seen) + np.arange(len(order))
        kept = block.drop_columns(["_digit", "_block", "position"])
        return kept.append_column("position", pa.array(new))

    return told.groupBy("_block").cogroup(begins.groupBy("_begin_block")).applyInArrow(place, rows.schema)
