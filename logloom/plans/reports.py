"""Report sections as tables, and the Markdown report as lines.

Sections are limited as their headings say (top 5, 10, 20); numbers are rounded and
texts cut here only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import fixed, shorten
from logloom.operators.stats import by_count, component_distribution
from logloom.plans.analyze import Analysis


def _thousands(n: Column) -> Column:
    return F.format_string("%,d", n.cast("bigint"))


def _second(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19)


def _ranked(df: DataFrame, *order) -> DataFrame:
    # Only ever over a section that has been limited, or over the level names.
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def kpis(summary: DataFrame, dashboard: bool = False) -> DataFrame:
    """``(ord, metric, value, shown)``: eight headline values, six on the dashboard."""
    number = lambda c: (F.col(c).cast("double"), _thousands(F.col(c)))
    plain = lambda c: (F.col(c).cast("double"), F.col(c).cast("string"))
    errors = F.concat(
        F.col("error_count").cast("string"), F.lit(" ("), fixed(F.col("error_pct"), 1), F.lit("%)")
    )
    coverage = F.concat(fixed(F.col("top10_coverage"), 1), F.lit("%"))
    cards = [
        ("Total lines", *number("total_lines")),
        ("Unique events", *plain("unique_events")),
        ("Errors", F.col("error_count").cast("double"), errors),
        ("Warnings", *plain("warning_count")),
        ("Top-10 coverage", F.col("top10_coverage"), coverage),
        ("Anomaly windows", *plain("n_anomaly_windows")),
        ("Repetition bursts", *plain("n_bursts")),
        ("Semantic anomaly templates", *plain("n_semantic_anomalies")),
    ]
    if dashboard:
        cards = cards[:6]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), v.alias("value"), s.alias("shown"))
            for i, (m, v, s) in enumerate(cards, 1)
        ]
    )
    return summary.select(F.inline(rows))


def level_table(levels: DataFrame) -> DataFrame:
    """``(level, count, percent)``."""
    return levels.select("level", "count", fixed(F.col("percentage"), 1).alias("percent"))


def top_events_table(stats: DataFrame, n: int = 10, cut: int = 60, with_times: bool = False) -> DataFrame:
    """``(rank, template, count, percent)`` of the most frequent events."""
    top = _ranked(by_count(stats).limit(n), F.desc("count"), "event_id")
    columns = ["rank", shorten(F.col("template"), cut).alias("template"), "count"]
    columns.append(fixed(F.col("frequency_pct"), 1).alias("percent"))
    if with_times:
        columns += [F.coalesce(_second(F.col(c)), F.lit("-")).alias(c) for c in ("first_seen", "last_seen")]
    return top.select(*columns)


def anomaly_table(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """``(timestamp, count, zscore, interpretation)`` of the first ``n`` in time."""
    return anomalies.orderBy("timestamp").limit(n).select(
        _second(F.col("timestamp")).alias("timestamp"),
        "count",
        fixed(F.col("count_zscore"), 1).alias("zscore"),
        "interpretation",
    )


def short_type(kind: Column) -> Column:
    """Compact anomaly type: ``volume/global↓``, at most 20 characters."""
    out = F.replace(kind, F.lit("_burst"), F.lit(""))
    out = F.replace(out, F.lit("_drop"), F.lit("↓"))
    return F.substring(F.replace(out, F.lit("+"), F.lit("/")), 1, 20)


def anomaly_type_table(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """``(timestamp, count, zscore, type)`` with the compact type."""
    return anomalies.orderBy("timestamp").limit(n).select(
        _second(F.col("timestamp")).alias("timestamp"),
        "count",
        fixed(F.col("count_zscore"), 1).alias("zscore"),
        short_type(F.col("anomaly_type")).alias("type"),
    )


def burst_table(bursts: DataFrame, n: int = 10) -> DataFrame:
    """``(timestamp, event_id, template, repeats)`` of the first ``n`` in time."""
    return bursts.orderBy("timestamp", "event_id").limit(n).select(
        _second(F.col("timestamp")).alias("timestamp"),
        "event_id",
        shorten(F.col("template"), 50).alias("template"),
        F.concat(F.col("count_in_window").cast("string"), F.lit("x")).alias("repeats"),
    )


def semantic_table(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """``(template_idx, template, distance, severity)``, farthest first."""
    return anomalies.orderBy(F.desc("distance"), "template_idx").limit(n).select(
        "template_idx", shorten(F.col("template"), 60).alias("template"), fixed(F.col("distance"), 3).alias("distance"), "severity"
    )


def cluster_table(clusters: DataFrame, n: int = 5) -> DataFrame:
    """``(cluster_id, size, percent, sample)``, largest first."""
    return clusters.orderBy(F.desc("size"), "cluster_id").limit(n).select(
        "cluster_id", "size", fixed(F.col("percentage"), 1).alias("percent"), shorten(F.col("sample"), 50).alias("sample")
    )


def timeline(series: DataFrame) -> DataFrame:
    return series.select("timestamp", "total", "error_count")


def component_panel(entries: DataFrame, n: int = 10) -> DataFrame:
    return component_distribution(entries, n).select("component", "count")


def count_profile(stats: DataFrame, n: int = 20) -> DataFrame:
    """``(rank, count)`` of the most frequent events, rank from 0."""
    top = _ranked(by_count(stats).limit(n), F.desc("count"), "event_id")
    return top.select((F.col("rank") - 1).alias("rank"), "count")


def _lines(df: DataFrame, section: int, rank: Column, line: Column, offset: int = 10) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), (rank + offset).cast("int").alias("ord"), line.alias("line")
    )


def _row(*cells) -> Column:
    cells = [c if isinstance(c, Column) else F.col(c) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def _found(count: Column, section: int, some: Column, heading: tuple[str, ...], nothing: str, summary: DataFrame) -> DataFrame:
    """The lead line and the table heading if there are findings, else one sentence."""
    texts = F.when(count > 0, F.array(some, *[F.lit(t) for t in heading])).otherwise(F.array(F.lit(nothing)))
    return summary.select(F.lit(section).alias("section"), F.posexplode(texts).alias("p", "line")).select(
        "section", (F.col("p") + 3).cast("int").alias("ord"), "line"
    )


# The headings, table heads and sentences of the reports below are their output format.


def markdown_report(result: Analysis, variant: str = "current") -> DataFrame:
    """``(section, ord, line)``: the Markdown report; order by the first two to read it.

    The ``legacy`` variant has five headline values, anomaly types instead of
    readings, and event ids instead of templates in the burst table.
    """
    if variant not in ("current", "legacy"):
        raise ValueError("variant must be 'current' or 'legacy'")
    legacy = variant == "legacy"
    spark = result.entries.sparkSession
    fixed_lines: list[tuple[int, int, str]] = []

    def put(section: int, at: int, *texts: str) -> None:
        fixed_lines.extend((section, at + i, t) for i, t in enumerate(texts))

    bold = lambda n: F.concat(F.lit("**"), n.cast("string"), F.lit("**"))
    cards = kpis(result.summary)
    if legacy:
        cards = cards.filter(F.col("ord") <= 5)
    head = F.concat(F.lit("- **"), F.col("metric"), F.lit(":** "), F.col("shown"))
    put(0, 0, f"# Log Analysis Report — {result.source}", "")
    parts = [_lines(cards, 0, F.col("ord"), head, 2)]
    put(0, 90, "")
    put(1, 0, "## Level Distribution", "", "| Level | Count | % |", "|---|---|---|")
    levels = _ranked(result.level_dist, F.desc("count"), "level")
    percent = lambda c: F.concat(fixed(F.col(c), 1), F.lit("%"))
    parts.append(_lines(levels, 1, F.col("rank"), _row("level", _thousands(F.col("count")), percent("percentage"))))
    put(2, 0, "", "## Top 10 Events", "", "| # | Template | Count | % |", "|---|---|---|---|")
    top = top_events_table(result.template_stats)
    share = F.concat(F.col("percent"), F.lit("%"))
    parts.append(_lines(top, 2, F.col("rank"), _row("rank", "template", _thousands(F.col("count")), share)))

    title = "## Temporal Anomalies" if legacy else "## Temporal Anomaly Windows"
    put(3, 0, "", title, "")
    n = F.col("n_anomaly_windows")
    if legacy:
        lead = F.concat(F.lit("Detected "), bold(n), F.lit(" anomalous windows. Top 10:"))
        heading = ("", "| Timestamp | Count | Z-Score | Type |", "|---|---|---|---|")
        nothing = "No significant temporal anomalies detected."
    else:
        lead = F.concat(bold(n), F.lit(" anomalous windows detected. Top 10:"))
        heading = ("", "| Timestamp | Count | Z-Score | Interpretation |", "|---|---|---|---|")
        nothing = "No temporal anomalies detected."
    parts.append(_found(n, 3, lead, heading, nothing, result.summary))
    first = _ranked(result.anomaly_windows.orderBy("timestamp").limit(10), "timestamp")
    count = _thousands(F.col("count")) if legacy else F.col("count")
    last = "anomaly_type" if legacy else "interpretation"
    line = _row(_second(F.col("timestamp")), count, fixed(F.col("count_zscore"), 1), last)
    parts.append(_lines(first, 3, F.col("rank"), line))

    put(4, 0, "", "## Repetition Bursts", "")
    n = F.col("n_bursts")
    seconds = result.bursts.agg(F.max("window_seconds").cast("string").alias("s")).scalar()
    lead = F.concat(bold(n), F.lit(" repetition bursts ("), F.coalesce(seconds, F.lit("")), F.lit("s windows). Top 10:"))
    if legacy:
        lead = F.concat(F.lit("Detected "), lead)
    heading = ("", f"| Timestamp | {'Event ID' if legacy else 'Event'} | Repeats |", "|---|---|---|")
    parts.append(_found(n, 4, lead, heading, "No repetition bursts detected.", result.summary))
    table = _ranked(burst_table(result.bursts), "timestamp", "event_id")
    parts.append(
        _lines(table, 4, F.col("rank"), _row("timestamp", "event_id" if legacy else "template", "repeats"))
    )

    put(5, 0, "", "## Semantic Anomalies", "")
    n = F.col("n_semantic_anomalies")
    lead = F.concat(bold(n), F.lit(" semantically anomalous templates. Top 10:"))
    if legacy:
        lead = F.concat(F.lit("Detected "), lead)
    heading = ("", "| Template | Distance | Severity |", "|---|---|---|")
    parts.append(_found(n, 5, lead, heading, "No semantic anomalies detected.", result.summary))
    table = _ranked(
        result.semantic_anomalies.orderBy(F.desc("distance"), "template_idx").limit(10), F.desc("distance"), "template_idx"
    )
    line = _row(shorten(F.col("template"), 60), fixed(F.col("distance"), 3), "severity")
    parts.append(_lines(table, 5, F.col("rank"), line))

    put(6, 0, "", "## Semantic Clusters", "")
    table = _ranked(cluster_table(result.cluster_summaries), F.desc("size"), "cluster_id")
    line = F.concat(
        F.lit("- **Cluster "), F.col("cluster_id").cast("string"), F.lit("**: "), F.col("size").cast("string"),
        F.lit(" templates ("), F.col("percent"), F.lit("%) — "), F.col("sample"),
    )
    parts.append(_lines(table, 6, F.col("rank"), line))
    if not legacy:
        put(7, 0, "")
    parts.append(spark.createDataFrame(fixed_lines, "section int, ord int, line string").coalesce(1))
    return reduce(DataFrame.unionByName, parts)


def text_report(result: Analysis) -> DataFrame:
    """``(section, ord, line)``: the report as running lists, with times in the event table."""
    spark = result.entries.sparkSession
    plain = lambda c: F.col(c).cast("string")
    bold = lambda c: F.concat(F.lit("**"), c.cast("string"), F.lit("**"))
    percent = lambda c: F.concat(fixed(F.col(c), 1), F.lit("%"))
    titles = [
        "## Level Distribution",
        "## Top 10 Most Frequent Events",
        "## Semantic Clusters",
        "## Temporal Anomalies (Bursts)",
        "## Repetition Bursts",
        "## Semantic Anomalies",
    ]
    fixed_lines = [(0, 0, f"# Log Analysis Report — {result.source}"), (0, 1, ""), (0, 3, "")]
    for i, title in enumerate(titles, 1):
        fixed_lines += [(i, 0, title), (i, 1, ""), (i, 90_000, "")]
    fixed_lines += [
        (2, 2, "| # | Event | Count | % Total | First Seen | Last Seen |"),
        (2, 3, "|---|---|---|---|---|---|"),
    ]
    header = F.concat_ws(
        " | ",
        F.concat(F.lit("**Total lines:** "), plain("total_lines")),
        F.concat(F.lit("**Unique events:** "), plain("unique_events")),
        F.concat(F.lit("**Errors:** "), plain("error_count"), F.lit(" ("), percent("error_pct"), F.lit(")")),
        F.concat(F.lit("**Warnings:** "), plain("warning_count")),
    )
    parts = [_lines(result.summary, 0, F.lit(2), header, 0)]

    levels = _ranked(result.level_dist, F.desc("count"), "level")
    line = F.concat(F.lit("- "), bold(F.col("level")), F.lit(": "), plain("count"), F.lit(" ("), percent("percentage"), F.lit(")"))
    parts.append(_lines(levels, 1, F.col("rank"), line))
    top = top_events_table(result.template_stats, cut=80, with_times=True)
    share = F.concat(F.col("percent"), F.lit("%"))
    parts.append(_lines(top, 2, F.col("rank"), _row("rank", "template", "count", share, "first_seen", "last_seen")))
    clusters = _ranked(result.cluster_summaries.orderBy(F.desc("size"), "cluster_id").limit(5), F.desc("size"), "cluster_id")
    line = F.concat(
        F.lit("- "), bold(F.concat(F.lit("Cluster "), plain("cluster_id"))), F.lit(" ("), plain("size"),
        F.lit(" templates, "), percent("percentage"), F.lit("): "), shorten(F.col("sample"), 80),
    )
    parts.append(_lines(clusters, 3, F.col("rank"), line))

    def lead(section: int, count: str, what: str, nothing: str) -> None:
        some = F.concat(F.lit("Detected "), bold(F.col(count)), F.lit(f" {what}:"))
        parts.append(_found(F.col(count), section, some, ("",), nothing, result.summary))

    lead(4, "n_anomaly_windows", "anomalous windows", "No significant temporal anomalies detected.")
    first = _ranked(result.anomaly_windows.orderBy("timestamp").limit(10), "timestamp")
    line = F.concat(
        F.lit("- "), bold(_second(F.col("timestamp"))), F.lit(": count="), plain("count"),
        F.lit(", z-score="), fixed(F.col("count_zscore"), 1), F.lit(", type="), F.col("anomaly_type"),
    )
    parts.append(_lines(first, 4, F.col("rank"), line))
    lead(5, "n_bursts", "repetition bursts", "No repetition bursts detected.")
    first = _ranked(result.bursts.orderBy("timestamp", "event_id").limit(10), "timestamp", "event_id")
    line = F.concat(
        F.lit("- "), bold(_second(F.col("timestamp"))), F.lit(": `"), plain("event_id"), F.lit("` repeated "),
        plain("count_in_window"), F.lit("x in "), plain("window_seconds"), F.lit("s"),
    )
    parts.append(_lines(first, 5, F.col("rank"), line))
    lead(6, "n_semantic_anomalies", "semantically anomalous templates", "No semantic anomalies detected.")
    order = (F.desc("distance"), "template_idx")
    first = _ranked(result.semantic_anomalies.orderBy(*order).limit(10), *order)
    line = F.concat(
        F.lit("- "), bold(shorten(F.col("template"), 100)), F.lit(" (distance="), fixed(F.col("distance"), 3),
        F.lit(", severity="), F.col("severity"), F.lit(")"),
    )
    parts.append(_lines(first, 6, F.col("rank"), line))
    parts.append(spark.createDataFrame(fixed_lines, "section int, ord int, line string").coalesce(1))
    return reduce(DataFrame.unionByName, parts)


def write_markdown(report: DataFrame, path: str) -> None:
    """The report as one text file; every section is limited, so one task suffices."""
    report.orderBy("section", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Save any result table as Parquet, CSV or JSON."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)
