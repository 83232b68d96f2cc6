"""Time features, gap-filled series, rolling and global scores, anomaly windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import shorten
from logloom.operators.numbering import cut_lineage, dense_number
from logloom.schema import from_micros, micros

MINUTE = 60_000_000
DAY = 1440 * MINUTE
HALO_CHUNK = 4096  # bins per rolling chunk
EPSILON = 1e-8


def bin_number(ts: Column, minutes: int, shift: Column | int = 0) -> Column:
    """Number of the fixed bin a timestamp lies in, from the epoch plus ``shift`` microseconds."""
    width = F.lit(minutes * MINUTE)
    us = micros(ts) - shift
    return ((us - F.pmod(us, width)) / width).cast("bigint")


def bin_start(number: Column, minutes: int, shift: Column | int = 0) -> Column:
    return from_micros(number * F.lit(minutes * MINUTE) + shift)


def temporal_features(entries: DataFrame, minutes: int = 5) -> DataFrame:
    """Add ``hour``, ``day_of_week`` (Monday 0) and ``window_id``; all 0 without a timestamp.

    ``window_id`` is the dense rank of the occupied bins: only the distinct bins are
    numbered, and joined back.
    """
    binned = entries.withColumn("_bin", bin_number(F.col("timestamp"), minutes))
    occupied = binned.filter(F.col("_bin").isNotNull()).select("_bin").distinct()
    # Stored, its size is known: the bins of years are broadcast, so a busy bin is not shuffled.
    ids = cut_lineage(dense_number(occupied, "_bin", "window_id"), "windows")
    return binned.join(ids, "_bin", "left").select(
        *entries.columns,
        F.coalesce(F.hour("timestamp"), F.lit(0)).alias("hour"),
        F.coalesce(F.weekday("timestamp"), F.lit(0)).alias("day_of_week"),
        F.coalesce("window_id", F.lit(0)).cast("bigint").alias("window_id"),
    )


def _origin_shift(binned_ts: DataFrame, minutes: int) -> Column | int:
    # Bins start at midnight of the first day. That is the epoch grid as long as the
    # bin divides a day; else the grid is shifted by the first day's remainder.
    if 1440 % minutes == 0:
        return 0
    first = binned_ts.agg(F.min("timestamp").alias("t")).scalar()
    us = micros(F.date_trunc("DAY", first).cast("timestamp_ntz"))
    return F.pmod(us, F.lit(minutes * MINUTE))


def binned_counts(entries: DataFrame, minutes: int = 5) -> DataFrame:
    """Occupied bins: ``(bin, timestamp, count, n_unique, error_count, warning_count)``.

    Rows are combined per (bin, event) first; the distinct count then is a plain
    count, and a bin that holds much of the log is spread over its events.
    """
    timed = entries.filter(F.col("timestamp").isNotNull())
    shift = _origin_shift(timed, minutes)
    per_event = (
        timed.select(bin_number(F.col("timestamp"), minutes, shift).alias("bin"), "event_id", "message_raw", "level")
        .groupBy("bin", "event_id")
        .agg(
            F.count("message_raw").alias("n"),
            F.count_if(F.col("level") == "Error").alias("errors"),
            F.count_if(F.col("level") == "Warning").alias("warnings"),
        )
    )
    binned = per_event.groupBy("bin").agg(
        F.sum("n").alias("count"),
        F.count("event_id").alias("n_unique"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
    )
    return binned.select(
        "bin", bin_start(F.col("bin"), minutes, shift).alias("timestamp"), "count", "n_unique", "error_count", "warning_count"
    )


def filled(binned: DataFrame, minutes: int = 5) -> DataFrame:
    """The same with every empty bin between the first and the last, at zero.

    Numbers come in two steps, coarse then fine, so that a long span is spread over
    tasks instead of growing one array.
    """
    step = 4096
    spans = binned.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.max_by("timestamp", "bin").alias("last"))
    coarse = spans.filter(F.col("lo").isNotNull()).select(
        "lo", "hi", "last", F.explode(F.sequence("lo", "hi", F.lit(step).cast("bigint"))).alias("base")
    )
    grid = coarse.repartition("base").select(
        "hi", "last", F.explode(F.sequence("base", F.least(F.col("base") + (step - 1), F.col("hi")))).alias("bin")
    )
    ahead = (F.col("hi") - F.col("bin")) * F.lit(minutes * MINUTE)
    grid = grid.select("bin", from_micros(micros(F.col("last")) - ahead).alias("timestamp"))
    counts = [c for c in binned.columns if c not in ("bin", "timestamp")]
    return grid.join(binned.drop("timestamp"), "bin", "left").na.fill(0, counts)


def time_series(entries: DataFrame, minutes: int = 5) -> DataFrame:
    """Gap-filled ``(timestamp, total, unique_templates, error_count, warning_count)``."""
    # One row per occupied bin, stored: the grid needs it twice.
    return filled(cut_lineage(binned_counts(entries, minutes), "bins"), minutes).select(
        "timestamp",
        F.col("count").alias("total"),
        F.col("n_unique").alias("unique_templates"),
        "error_count",
        "warning_count",
    )


def adaptive_width(n_bins: int) -> int | None:
    """Rolling width for a series of ``n_bins``; none below five bins."""
    if n_bins < 5:
        return None
    return min(10, max(3, n_bins // 5))


def bin_span(binned: DataFrame) -> int:
    """Number of bins from the first to the last occupied one (one scalar to the driver)."""
    row = binned.agg((F.max("bin") - F.min("bin") + 1).alias("n")).first()
    return row["n"] or 0


def rolling(series: DataFrame, columns, width: int, by: list[str] | None = None, chunk: int = HALO_CHUNK) -> DataFrame:
    """Add trailing ``<c>_ma`` and ``<c>_std`` over ``width`` bins of a dense series.

    The series is cut into chunks of bin numbers; each chunk also gets the last
    ``width - 1`` bins of the one before, so no window spans the whole series.
    ``by`` keeps several series apart.
    """
    by = by or []
    at = F.col("bin")
    own = series.withColumn("_chunk", F.floor(at / chunk)).withColumn("_halo", F.lit(False))
    tail = own.filter(F.pmod(at, F.lit(chunk)) >= chunk - (width - 1))
    tail = tail.withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True))
    w = Window.partitionBy(*by, "_chunk").orderBy("bin").rowsBetween(-(width - 1), 0)
    scored = own.unionByName(tail).select(
        "*",
        *[F.avg(c).over(w).alias(f"{c}_ma") for c in columns],
        *[F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)).alias(f"{c}_std") for c in columns],
    )
    return scored.filter(~F.col("_halo")).drop("_chunk", "_halo")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(EPSILON))


def scored_series(series: DataFrame, width: int) -> DataFrame:
    """Rolling scores of volume and diversity, and the score of volume over the whole series."""
    spread = series.agg(F.struct(F.avg("count").alias("mean"), F.stddev_samp("count").alias("std")).alias("s")).scalar()
    rolled = rolling(series.select("bin", "timestamp", "count", "n_unique"), ["count", "n_unique"], width)
    return rolled.select(
        "bin",
        "timestamp",
        "count",
        "n_unique",
        zscore(F.col("count"), F.col("count_ma"), F.col("count_std")).alias("count_zscore"),
        zscore(F.col("n_unique"), F.col("n_unique_ma"), F.col("n_unique_std")).alias("unique_zscore"),
        zscore(F.col("count"), spread["mean"], spread["std"]).alias("global_zscore"),
    )


def is_anomalous(threshold: float) -> Column:
    return (
        (F.abs("count_zscore") > threshold)
        | (F.abs("unique_zscore") > threshold)
        | (F.abs("global_zscore") > 1.5 * threshold)
    )


def anomaly_type(threshold: float) -> Column:
    """``volume_burst+global_drop`` and the like; every score is held against the plain threshold."""
    parts = [
        F.when(F.col(c) > threshold, f"{name}_burst").when(F.col(c) < -threshold, f"{name}_drop")
        for c, name in (("count_zscore", "volume"), ("unique_zscore", "diversity"), ("global_zscore", "global"))
    ]
    joined = F.concat_ws("+", *parts)
    return F.when(joined == "", "unknown").otherwise(joined)


def interpretation(kind: Column, count: Column, top: Column, minutes: int = 5) -> Column:
    """Reading of an anomaly in words, with its two leading events. The phrases are fixed values of the output format."""
    said = F.concat_ws(
        " + ",
        F.when(
            F.contains(kind, F.lit("volume_burst")),
            F.concat(F.lit("volume burst ("), count.cast("string"), F.lit(f" events in {minutes}min)")),
        ),
        F.when(F.contains(kind, F.lit("diversity_burst")), "event diversity spike"),
        F.when(F.contains(kind, F.lit("global_burst")), "global outlier"),
        F.when(F.contains(kind, F.lit("drop")), "activity drop"),
    )
    said = F.when(said == "", "anomalous pattern").otherwise(said)
    leading = F.transform(
        F.slice(top, 1, 2),
        lambda e: F.concat(F.lit('"'), e["template"], F.lit('" ('), e["count"].cast("string"), F.lit("x)")),
    )
    return F.when(F.size(top) > 0, F.concat(said, F.lit(". Top: "), F.array_join(leading, ", "))).otherwise(said)


def top_events(entries: DataFrame, windows: DataFrame | None = None, k: int = 3, minutes: int = 5, label: int = 40) -> DataFrame:
    """``(bin, top_events)``: the ``k`` most frequent events of each bin, ties by event id.

    An event is labelled with the template it had first in that bin. ``windows``
    (with a ``bin`` column) restricts the result to those bins.
    """
    timed = entries.filter(F.col("timestamp").isNotNull())
    number = bin_number(F.col("timestamp"), minutes, _origin_shift(timed, minutes))
    rows = timed.select(number.alias("bin"), "event_id", "template", "line")
    per_template = rows.groupBy("bin", "event_id", "template").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("line")
    )
    # Rows are combined before the join, so a bin that holds much of the log is not shuffled raw.
    if windows is not None:
        per_template = per_template.join(windows.select("bin"), "bin", "left_semi")
    per_event = per_template.groupBy("bin", "event_id").agg(
        F.sum("n").alias("count"), F.min(F.struct("line", "template"))["template"].alias("template")
    )
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("count"), "event_id"))
    leading = per_event.withColumn("rank", rank).filter(F.col("rank") <= k)
    shown = F.coalesce(
        shorten(F.col("template"), label), F.concat(F.lit("event_"), F.col("event_id").cast("string"))
    )
    return leading.groupBy("bin").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "count", shown.alias("template")))),
            lambda e: F.struct(e["count"].alias("count"), e["template"].alias("template")),
        ).alias("top_events")
    )


def anomaly_windows(
    entries: DataFrame, minutes: int = 5, threshold: float = 2.5, with_top: bool = True, width: int | None = None
) -> DataFrame:
    """Bins whose volume or diversity stands out, with scores, type, leading events and text.

    ``threshold=3, with_top=False`` gives the older variant without the last two.
    The rolling width follows from the number of bins; a series of fewer than five
    has no anomalies.
    """
    binned = cut_lineage(binned_counts(entries, minutes), "bins")
    width = width or adaptive_width(bin_span(binned))
    scores = scored_series(filled(binned, minutes), width or 1)
    # At most a few bins of many: stored, they are small enough for any join.
    found = cut_lineage(scores.filter(is_anomalous(threshold) if width else F.lit(False)), "found")
    kind = anomaly_type(threshold)
    columns = ["timestamp", "count", "count_zscore", "unique_zscore", "global_zscore"]
    if not with_top:
        return found.select(*columns, kind.alias("anomaly_type"))
    top = top_events(entries, found, minutes=minutes)
    joined = found.join(top, "bin", "left").withColumn("anomaly_type", kind)
    events = F.coalesce("top_events", F.array().cast("array<struct<count:bigint,template:string>>"))
    return joined.select(
        *columns,
        "anomaly_type",
        events.alias("top_events"),
        interpretation(F.col("anomaly_type"), F.col("count"), events, minutes).alias("interpretation"),
    )


def volume_bursts(entries: DataFrame, minutes: int = 5, threshold: float = 3.0, width: int = 10) -> DataFrame:
    """Bins whose row count lies above the rolling mean by more than ``threshold`` deviations.

    The window includes the bin itself, so at width 10 no score can exceed 2.85.
    """
    timed = entries.filter(F.col("timestamp").isNotNull())
    shift = _origin_shift(timed, minutes)
    binned = timed.groupBy(bin_number(F.col("timestamp"), minutes, shift).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    binned = binned.withColumn("timestamp", bin_start(F.col("bin"), minutes, shift))
    scored = rolling(filled(cut_lineage(binned, "bins"), minutes), ["count"], width)
    z = zscore(F.col("count"), F.col("count_ma"), F.col("count_std"))
    return scored.select(
        "timestamp", "count", F.col("count_ma").alias("ma"), F.col("count_std").alias("std"), z.alias("zscore")
    ).filter(F.col("zscore") > threshold)
