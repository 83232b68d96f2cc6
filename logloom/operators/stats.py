"""Template statistics, distributions and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schema import micros


def template_stats(entries: DataFrame, approx: bool = False) -> DataFrame:
    """One row per event: counts, time span, modal component, first template, rate, share.

    Rows are first combined per (event, template, component) and per (event,
    message), so an event that holds much of the log is spread before it is merged.
    ``approx`` estimates the distinct messages instead of counting them.
    """
    parts = entries.groupBy("event_id", "template", "component").agg(
        F.count("message_raw").alias("n"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        F.min("line").alias("line"),
    )
    per_component = parts.groupBy("event_id", "component").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min(F.struct("line", "template")).alias("first"),
    )
    # Most frequent component, the smallest name on a tie; null names do not count.
    rank = F.when(F.col("component").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("component").alias("c")))
    merged = per_component.groupBy("event_id").agg(
        F.sum("n").alias("count"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.min("first")["template"].alias("template"),
        F.coalesce(F.min(rank)["c"], F.lit("")).alias("components"),
    )
    if approx:
        unique = entries.groupBy("event_id").agg(F.approx_count_distinct("message_raw").alias("unique_messages"))
    else:
        pairs = entries.select("event_id", "message_raw").distinct()
        unique = pairs.groupBy("event_id").agg(F.count("message_raw").alias("unique_messages"))
    total = entries.agg(F.count("message_raw").alias("n")).scalar()
    seconds = F.coalesce(
        (micros(F.col("last_seen")) - micros(F.col("first_seen"))) / F.lit(1_000_000), F.lit(0.0)
    )
    return merged.join(unique, "event_id").select(
        "event_id",
        "template",
        "count",
        "first_seen",
        "last_seen",
        "unique_messages",
        "components",
        seconds.alias("duration_seconds"),
        (F.col("count") / (seconds / 3600 + 1)).alias("rate_per_hour"),
        (F.col("count") / total * 100).alias("frequency_pct"),
    )


def by_count(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Most frequent first, ties by key."""
    return df.orderBy(F.desc("count"), key)


def top_problems(entries: DataFrame, stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent events with their share of all rows."""
    rows = entries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return by_count(stats).limit(n).withColumn("problem_ratio", F.col("count") / rows * 100)


def _with_share(dist: DataFrame) -> DataFrame:
    total = dist.agg(F.sum("count").alias("n")).scalar()
    return dist.withColumn("percentage", F.col("count") / total * 100)


def level_distribution(entries: DataFrame) -> DataFrame:
    """``(level, count, percentage)`` over rows with a level."""
    # Counting the key drops its nulls without a filter that would repeat its expression.
    return _with_share(entries.groupBy("level").agg(F.count("level").alias("count")).filter(F.col("count") > 0))


def component_distribution(entries: DataFrame, n: int | None = 15) -> DataFrame:
    """``(component, count, percentage)`` of the ``n`` most frequent; shares are within them."""
    named = entries.groupBy("component").agg(F.count("component").alias("count")).filter(F.col("count") > 0)
    dist = by_count(named, "component")
    return _with_share(dist.limit(n) if n else dist)


def hour_distribution(entries: DataFrame, include_untimed: bool = False) -> DataFrame:
    """``(hour, count, percentage)``; untimed rows are dropped, or counted at hour 0."""
    hour = F.hour("timestamp")
    if include_untimed:
        rows = entries.select(F.coalesce(hour, F.lit(0)).alias("hour"))
    else:
        rows = entries.filter(F.col("timestamp").isNotNull()).select(hour.alias("hour"))
    return _with_share(rows.groupBy("hour").agg(F.count(F.lit(1)).alias("count")))


def pattern_summary(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of totals, from the entries and their template statistics.

    Percentages keep their full value; round them for display only.
    """
    rows = entries.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("level") == "Error").alias("error_count"),
        F.count_if(F.col("level") == "Warning").alias("warning_count"),
    )
    events = stats.agg(
        F.struct(
            F.count(F.lit(1)).alias("unique_events"),
            F.count_if(F.col("frequency_pct") < 1).alias("rare_events_count"),
        ).alias("e")
    ).scalar()
    head = (
        by_count(stats)
        .limit(10)
        .agg(
            F.struct(
                F.sum("count").alias("count"),
                F.min(
                    F.struct((-F.col("count")).alias("k"), "event_id", "template", "count", "frequency_pct")
                ).alias("top"),
            ).alias("h")
        )
        .scalar()
    )
    top = head["top"]
    total = F.col("total_lines")
    share = lambda n: F.when(total > 0, n / total * 100).otherwise(0.0)
    return rows.select(
        "total_lines",
        events["unique_events"].alias("unique_events"),
        F.coalesce(top["template"], F.lit("")).alias("top_event"),
        F.coalesce(top["count"], F.lit(0)).cast("bigint").alias("top_event_count"),
        F.coalesce(top["frequency_pct"], F.lit(0.0)).alias("top_event_pct"),
        "error_count",
        share(F.col("error_count")).alias("error_pct"),
        "warning_count",
        share(F.coalesce(head["count"], F.lit(0))).alias("top10_coverage"),
        events["rare_events_count"].alias("rare_events_count"),
    )


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def run_summary(patterns: DataFrame, anomalies: DataFrame, bursts: DataFrame, semantic: DataFrame) -> DataFrame:
    """The pattern summary with the number of findings of each detector."""
    return patterns.select(
        "*",
        row_count(anomalies).alias("n_anomaly_windows"),
        row_count(bursts).alias("n_bursts"),
        row_count(semantic).alias("n_semantic_anomalies"),
    )


def cluster_summary(members: DataFrame, with_templates: bool = False) -> DataFrame:
    """``(cluster_id, size, percentage, sample)`` from ``(template_idx, template, cluster)``.

    The sample is the first member. ``members`` itself is the list of who belongs
    where; ``with_templates`` also packs it, in index order, into one array per
    cluster, which suits clusters that fit into one row.
    """
    total = row_count(members)
    out = members.groupBy(F.col("cluster").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct("template_idx", "template"))["template"].alias("sample"),
        *(
            [
                F.transform(
                    F.array_sort(F.collect_list(F.struct("template_idx", "template"))), lambda s: s["template"]
                ).alias("templates")
            ]
            if with_templates
            else []
        ),
    )
    return out.withColumn("percentage", F.col("size") / total * 100)
