"""Repetition bursts: an event many times within a short look-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.numbering import cut_lineage
from logloom.schema import from_micros, micros

def last_templates(entries: DataFrame) -> DataFrame:
    """``(event_id, template)`` with the template each event had last."""
    parts = entries.groupBy("event_id", "template").agg(F.max("line").alias("line"))
    return parts.groupBy("event_id").agg(F.max(F.struct("line", "template"))["template"].alias("template"))


def busy_intervals(rows: DataFrame, min_repeats: int, length: int) -> DataFrame:
    """``event_id, count, start, end`` of the stretches of time (end excluded) in which an event has ``min_repeats`` rows or more in reach.

    ``rows(event_id, t, n)``: how many rows of an event have which time, in microseconds. Time is cut into buckets
    as long as the look-back, and each bucket of an event is swept once: rows enter at their time and leave
    after the look-back, and between two moves the count stands still. So there are at most
    about twice as many stretches as times of an event. Only buckets that can reach ``min_repeats`` are swept.
    """
    size = F.lit(length)
    rows = rows.withColumn("bucket", ((F.col("t") - F.pmod(F.col("t"), size)) / size).cast("bigint"))
    sums = rows.groupBy("event_id", "bucket").agg(F.sum("n").alias("own"))
    # Rows of a bucket count in it and, until they leave, in the next one.
    later = sums.select("event_id", (F.col("bucket") + 1).alias("bucket"), F.col("own").alias("carried"))
    reach = (
        sums.join(later, ["event_id", "bucket"], "full")
        .na.fill(0, ["own", "carried"])
        .filter(F.col("own") + F.col("carried") >= min_repeats)
    )
    keys = ["event_id", "bucket"]
    step = lambda df, t, delta: df.select(*keys, t.alias("t"), delta.cast("bigint").alias("delta"))
    t = F.col("t")
    carried = step(reach, F.col("bucket") * size, F.col("carried"))
    enter = step(rows, t, F.col("n"))
    leave = step(rows.withColumn("bucket", F.col("bucket") + 1), t + size + 1, -F.col("n"))
    moves = enter.unionByName(leave).join(reach.select(*keys), keys, "left_semi").unionByName(carried)
    moves = moves.groupBy(*keys, "t").agg(F.sum("delta").alias("delta"))
    in_order = Window.partitionBy(*keys).orderBy("t")
    counted = moves.select(
        "event_id",
        F.sum("delta").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("count"),
        t.alias("start"),
        F.coalesce(F.lead("t").over(in_order), (F.col("bucket") + 1) * size).alias("end"),
    )
    return counted.filter((F.col("count") >= min_repeats) & (F.col("start") < F.col("end")))


def _ranked_times(stamps: DataFrame, points: DataFrame) -> DataFrame:
    """``t, is_stamp, before``: for each time of ``points(t)`` the number of ``stamps(t)`` before it; for each stamp its own number from 0.

    Both are sorted by sampled ranges; a running sum over one row per range gives the offsets.
    """
    both = points.select("t", F.lit(0).alias("is_stamp")).unionByName(stamps.select("t", F.lit(1).alias("is_stamp")))
    ranged = both.repartitionByRange("t", "is_stamp").select("*", F.spark_partition_id().alias("part"))
    stored = cut_lineage(ranged, "times")
    offsets = stored.groupBy("part").agg(F.sum("is_stamp").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("t", "is_stamp").rowsBetween(Window.unboundedPreceding, 0)
    ranked = stored.withColumn("seen", F.sum("is_stamp").over(inside)).join(offsets, "part")
    return cut_lineage(ranked.select("t", "is_stamp", (F.col("offset") + F.col("seen") - F.col("is_stamp")).alias("before")), "ranks")


def repetition_bursts(
    entries: DataFrame, min_repeats: int = 5, seconds: int = 10, own_event_only: bool = False, with_template: bool = True
) -> DataFrame:
    """Every (timestamp t, event) with at least ``min_repeats`` rows in ``[t - seconds, t]``.

    ``t`` runs over all timestamps of the log, also those of other events, unless
    ``own_event_only``. Timestamps are numbered, and each busy stretch of an event (:func:`busy_intervals`) is the numbers
    from the first in it to the last, so the work grows with the rows and the result however fine the stamps
    are: no timestamp meets an event that is not reported at it. A busy second costs its rows, not their square.
    """
    length = seconds * 1_000_000
    timed = entries.filter(F.col("timestamp").isNotNull()).select(micros(F.col("timestamp")).alias("t"), "event_id")
    # Stored, so that the log is read once and no later join is moved below this combine,
    # where it would meet the raw rows of a busy event.
    rows = cut_lineage(timed.groupBy("event_id", "t").agg(F.count(F.lit(1)).alias("n")), "moments")
    busy = cut_lineage(busy_intervals(rows, min_repeats, length), "busy")
    ranks = _ranked_times(rows.select("t").distinct(), busy.select(F.explode(F.array("start", "end")).alias("t")).distinct())
    of_point = ranks.filter("is_stamp = 0")
    first, last = (of_point.select(F.col("t").alias(at), F.col("before").alias(name)) for at, name in (("start", "first"), ("end", "beyond")))
    numbered = busy.join(first, "start").join(last, "end").filter(F.col("first") < F.col("beyond"))
    looks = numbered.select("event_id", F.col("count").alias("count_in_window"), F.explode(F.sequence("first", F.col("beyond") - 1)).alias("before"))
    found = looks.join(ranks.filter("is_stamp = 1").select("before", "t"), "before")
    if own_event_only:
        found = found.join(rows.select("event_id", "t"), ["event_id", "t"], "left_semi")
    found = found.select(from_micros(F.col("t")).alias("timestamp"), "event_id", "count_in_window", F.lit(seconds).alias("window_seconds"))
    if not with_template:
        return found
    return found.join(last_templates(entries), "event_id", "left").select(
        "timestamp",
        "event_id",
        F.coalesce("template", F.lit("")).alias("template"),
        "count_in_window",
        "window_seconds",
    )
