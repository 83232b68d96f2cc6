"""Registered queries on the report as lines, on written tables, and on logs without times, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import bursts as B
from logloom.operators import semantics as E
from logloom.operators import stats as S
from logloom.operators import timeseries as W
from logloom.operators.numbering import cut_lineage
from logloom.plans import reports as R
from logloom.plans.analyze import Analysis
from workload import inputs as I
from workload.inputs import sql
from workload.more import _folder
from workload.queries import query
from workload.reports import _ALL, _cards


def _analysis(spark, sf) -> Analysis:
    """A run over the log with masked templates, the vectors and their labels."""
    rows = I.gapped(spark, sf)
    vectors = cut_lineage(I.vectors(spark, sf), "vectors")
    stats = cut_lineage(S.template_stats(rows), "stats")
    anomalies = cut_lineage(W.anomaly_windows(rows), "anomalies")
    repeats = cut_lineage(B.repetition_bursts(rows, 3, 600), "bursts")
    semantics = cut_lineage(E.semantic_anomalies(E.dense_distances(vectors.drop("label")), 0.8), "semantics")
    members = vectors.select("template_idx", "template", F.col("label").alias("cluster"))
    summary = S.run_summary(S.pattern_summary(rows, stats), anomalies, repeats, semantics)
    return Analysis(
        "events", rows, stats, W.time_series(rows), anomalies, repeats, semantics, S.level_distribution(rows), S.component_distribution(rows),
        S.hour_distribution(rows), members, S.cluster_summary(members), cut_lineage(summary, "summary"),
    )


# The sentences and headings of the reports, repeated here so that the SQL does not depend on the package.


def _texts(section: int, at: int, *texts: str) -> list[str]:
    return [f"SELECT {section} AS section, {at + i} AS ord, '{t}' AS line" for i, t in enumerate(texts)]


def _found(section: int, count: str, lead: str, heading: tuple[str, ...], nothing: str) -> list[str]:
    some = [f"SELECT {section}, 3, {lead} FROM run WHERE {count} > 0"]
    some += [f"SELECT {section}, {4 + i}, '{t}' FROM run WHERE {count} > 0" for i, t in enumerate(heading)]
    return [*some, f"SELECT {section}, 3, '{nothing}' FROM run WHERE {count} = 0"]


def _rows(section: int, source: str, order: str, line: str, limit: int | None = 10) -> str:
    few = f"WHERE r <= {limit}" if limit else ""
    return f"SELECT {section}, 10 + r, {line} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM {source}) {few}"


_SECOND = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_LEVELS = "(SELECT level, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM gapped GROUP BY level)"
_GROUPS = "(SELECT label, count(*) AS size, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM embeddings) AS share, arg_min('vector ' || vec_id, vec_id) AS sample FROM embeddings GROUP BY label)"
_COMMA = "format('{:,}', count)"


def _markdown(legacy: bool) -> str:
    detected = "'Detected ' || " if legacy else ""
    stamp = _SECOND.format("timestamp")
    parts = _texts(0, 0, "# Log Analysis Report — events", "")
    parts.append(f"SELECT 0, ord + 2, '- **' || metric || ':** ' || shown FROM ({_cards(5 if legacy else 8)})")
    parts += _texts(0, 90, "")
    parts += _texts(1, 0, "## Level Distribution", "", "| Level | Count | % |", "|---|---|---|")
    parts.append(_rows(1, _LEVELS, "count DESC, level", f"'| ' || level || ' | ' || {_COMMA} || ' | ' || printf('%.1f', share) || '% |'", None))
    parts += _texts(2, 0, "", "## Top 10 Events", "", "| # | Template | Count | % |", "|---|---|---|---|")
    parts.append(_rows(2, "stats", "count DESC, event_id", f"'| ' || r || ' | ' || template[1:60] || ' | ' || {_COMMA} || ' | ' || printf('%.1f', frequency_pct) || '% |'"))
    n, last = "n_anomaly_windows", "Type" if legacy else "Interpretation"
    parts += _texts(3, 0, "", "## Temporal Anomalies" if legacy else "## Temporal Anomaly Windows", "")
    lead = f"'Detected **' || {n} || '** anomalous windows. Top 10:'" if legacy else f"'**' || {n} || '** anomalous windows detected. Top 10:'"
    nothing = "No significant temporal anomalies detected." if legacy else "No temporal anomalies detected."
    parts += _found(3, n, lead, ("", f"| Timestamp | Count | Z-Score | {last} |", "|---|---|---|---|"), nothing)
    shown, what = (_COMMA, "anomaly_type") if legacy else ("count", "interpretation")
    parts.append(_rows(3, "readings", "timestamp", f"'| ' || {stamp} || ' | ' || {shown} || ' | ' || printf('%.1f', count_zscore) || ' | ' || {what} || ' |'"))
    n = "n_bursts"
    parts += _texts(4, 0, "", "## Repetition Bursts", "")
    heading = ("", f"| Timestamp | {'Event ID' if legacy else 'Event'} | Repeats |", "|---|---|---|")
    parts += _found(4, n, f"{detected}'**' || {n} || '** repetition bursts (600s windows). Top 10:'", heading, "No repetition bursts detected.")
    what = "event_id" if legacy else "template[1:50]"
    parts.append(_rows(4, "bursts", "timestamp, event_id", f"'| ' || {stamp} || ' | ' || {what} || ' | ' || count_in_window || 'x |'"))
    n = "n_semantic_anomalies"
    parts += _texts(5, 0, "", "## Semantic Anomalies", "")
    lead = f"{detected}'**' || {n} || '** semantically anomalous templates. Top 10:'"
    parts += _found(5, n, lead, ("", "| Template | Distance | Severity |", "|---|---|---|"), "No semantic anomalies detected.")
    far = "distance DESC, template_idx"
    parts.append(_rows(5, "semantic", far, "'| ' || template[1:60] || ' | ' || printf('%.3f', distance) || ' | ' || severity || ' |'"))
    parts += _texts(6, 0, "", "## Semantic Clusters", "")
    line = "'- **Cluster ' || label || '**: ' || size || ' templates (' || printf('%.1f', share) || '%) — ' || sample"
    parts.append(_rows(6, _GROUPS, "size DESC, label", line, 5))
    if not legacy:
        parts += _texts(7, 0, "")
    return sql("\nUNION ALL ".join(parts), *_ALL)


def _running_text() -> str:
    stamp = _SECOND.format("timestamp")
    titles = (
        "## Level Distribution", "## Top 10 Most Frequent Events", "## Semantic Clusters", "## Temporal Anomalies (Bursts)", "## Repetition Bursts", "## Semantic Anomalies",
    )
    parts = [*_texts(0, 0, "# Log Analysis Report — events", ""), *_texts(0, 3, "")]
    for i, title in enumerate(titles, 1):
        parts += [*_texts(i, 0, title, ""), *_texts(i, 90_000, "")]
    parts += _texts(2, 2, "| # | Event | Count | % Total | First Seen | Last Seen |", "|---|---|---|---|---|---|")
    parts.append("""SELECT 0, 2, '**Total lines:** ' || total_lines || ' | **Unique events:** ' || unique_events || ' | **Errors:** ' || error_count || ' ('
 || printf('%.1f', error_pct) || '%) | **Warnings:** ' || warning_count FROM run""")
    parts.append(_rows(1, _LEVELS, "count DESC, level", "'- **' || level || '**: ' || count || ' (' || printf('%.1f', share) || '%)'", None))
    seen = [f"coalesce({_SECOND.format(c)}, '-')" for c in ("first_seen", "last_seen")]
    cells = ["r", "template[1:80]", "count", "printf('%.1f', frequency_pct) || '%'", *seen]
    parts.append(_rows(2, "stats", "count DESC, event_id", "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"))
    line = "'- **Cluster ' || label || '** (' || size || ' templates, ' || printf('%.1f', share) || '%): ' || sample"
    parts.append(_rows(3, _GROUPS, "size DESC, label", line, 5))
    for section, n, what, nothing in (
        (4, "n_anomaly_windows", "anomalous windows", "No significant temporal anomalies detected."),
        (5, "n_bursts", "repetition bursts", "No repetition bursts detected."),
        (6, "n_semantic_anomalies", "semantically anomalous templates", "No semantic anomalies detected."),
    ):
        parts += _found(section, n, f"'Detected **' || {n} || '** {what}:'", ("",), nothing)
    parts.append(_rows(4, "readings", "timestamp", f"'- **' || {stamp} || '**: count=' || count || ', z-score=' || printf('%.1f', count_zscore) || ', type=' || anomaly_type"))
    parts.append(_rows(5, "bursts", "timestamp, event_id", f"'- **' || {stamp} || '**: `' || event_id || '` repeated ' || count_in_window || 'x in 600s'"))
    line = "'- **' || template[1:100] || '** (distance=' || printf('%.3f', distance) || ', severity=' || severity || ')'"
    parts.append(_rows(6, "semantic", "distance DESC, template_idx", line))
    return sql("\nUNION ALL ".join(parts), *_ALL)


def _typed(text: str) -> str:
    head, _, body = text.rpartition("\nSELECT 0 AS section, 0 AS ord")
    return f"{head}\nSELECT section::INTEGER AS section, ord::INTEGER AS ord, line FROM (SELECT 0 AS section, 0 AS ord{body})"


@query(_typed(_markdown(False)))
def report_markdown_lines(spark, sf):
    return R.markdown_report(_analysis(spark, sf))


@query(_typed(_markdown(True)))
def report_markdown_legacy_lines(spark, sf):
    return R.markdown_report(_analysis(spark, sf), "legacy")


@query(_typed(_running_text()))
def report_text_lines(spark, sf):
    return R.text_report(_analysis(spark, sf))


@query(sql("SELECT event_id, template, count, 'parquet' AS written FROM stats UNION ALL SELECT event_id, template, count, 'csv' FROM stats UNION ALL SELECT event_id, template, count, 'json' FROM stats", *_ALL))
def tables_written_and_read(spark, sf):
    """A result table saved in each format and read back."""
    stats = cut_lineage(S.template_stats(I.gapped(spark, sf)).select("event_id", "template", "count"), "stats")
    top, out = _folder(spark, "saved"), []
    for fmt, options in (("parquet", {}), ("csv", {"header": True, "escape": '"'}), ("json", {})):
        R.write_table(stats, f"{top}/{fmt}", fmt, **options)
        read = spark.read.schema(stats.schema).options(**options).format(fmt).load(f"{top}/{fmt}")
        out.append(read.withColumn("written", F.lit(fmt)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(sql("SELECT count(*) AS lines, 0::BIGINT AS windows, 0::BIGINT AS bursts, 0::BIGINT AS series, 0::BIGINT AS hours, count(*) AS untimed_lines FROM tagged"))
def log_without_times(spark, sf):
    """A log whose lines have no time: findings in time are empty, hours and windows zero."""
    rows = I.tagged(spark, sf).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    features = W.temporal_features(rows)
    zero = (F.col("hour") == 0) & (F.col("day_of_week") == 0) & (F.col("window_id") == 0)
    out = features.agg(F.count(F.lit(1)).alias("lines"), F.count_if(zero).alias("untimed_lines"))
    found = {"windows": W.anomaly_windows(rows), "bursts": B.repetition_bursts(rows), "series": W.time_series(rows), "hours": S.hour_distribution(rows)}
    for name, df in found.items():
        out = out.withColumn("one", F.lit(1)).join(df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1)), "one").drop("one")
    return out.select("lines", "windows", "bursts", "series", "hours", "untimed_lines")
