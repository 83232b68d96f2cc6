"""Registered report queries: every report table over the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import bursts as B
from logloom.operators import semantics as E
from logloom.operators import stats as S
from logloom.operators import timeseries as W
from logloom.plans import analyze as A
from logloom.plans import reports as R
from workload import inputs as I
from workload.inputs import sql
from workload.queries import _PATTERNS, _PATTERN_COLUMNS, _SERIES, _STATS, _VECTORS, _burst_sql, query, rounded  # noqa: F401

_BURSTS = ("bursts", _burst_sql(600, 3))
_SEMANTIC = ("semantic", "SELECT *, CASE WHEN distance > 1.2 THEN 'high' ELSE 'medium' END AS severity FROM distances WHERE distance > 0.8")
_RUN = (
    "run",
    """SELECT p.*, (SELECT count(*) FROM found) AS n_anomaly_windows, (SELECT count(*) FROM bursts) AS n_bursts,
 (SELECT count(*) FROM semantic) AS n_semantic_anomalies FROM patterns p""",
)
_ALL = (_STATS, _PATTERNS, *_SERIES, _BURSTS, *_VECTORS, _SEMANTIC, _RUN)


def _run(spark, sf):
    rows = I.gapped(spark, sf)
    stats = S.template_stats(rows)
    return S.run_summary(
        S.pattern_summary(rows, stats),
        W.anomaly_windows(rows, with_top=False),
        B.repetition_bursts(rows, 3, 600, with_template=False),
        E.semantic_anomalies(E.dense_distances(I.vectors(spark, sf)), 0.8),
    )


@query(sql(f"SELECT {_PATTERN_COLUMNS}, n_anomaly_windows, n_bursts, n_semantic_anomalies FROM run", *_ALL))
def run_summary(spark, sf):
    return rounded(_run(spark, sf), "top_event_pct", "error_pct", "top10_coverage")


def _cards(n):
    return f"""SELECT CAST(ord AS INTEGER) AS ord, metric, round(value, 6) AS value, shown FROM (
 SELECT 1 AS ord, 'Total lines' AS metric, total_lines::DOUBLE AS value, format('{{:,}}', total_lines) AS shown FROM run
 UNION ALL SELECT 2, 'Unique events', unique_events, unique_events::VARCHAR FROM run
 UNION ALL SELECT 3, 'Errors', error_count, error_count || ' (' || printf('%.1f', error_pct) || '%)' FROM run
 UNION ALL SELECT 4, 'Warnings', warning_count, warning_count::VARCHAR FROM run
 UNION ALL SELECT 5, 'Top-10 coverage', top10_coverage, printf('%.1f', top10_coverage) || '%' FROM run
 UNION ALL SELECT 6, 'Anomaly windows', n_anomaly_windows, n_anomaly_windows::VARCHAR FROM run
 UNION ALL SELECT 7, 'Repetition bursts', n_bursts, n_bursts::VARCHAR FROM run
 UNION ALL SELECT 8, 'Semantic anomaly templates', n_semantic_anomalies, n_semantic_anomalies::VARCHAR FROM run) WHERE ord <= {n}"""


@query(sql(_cards(8), *_ALL))
def report_kpis(spark, sf):
    return rounded(R.kpis(_run(spark, sf)), "value")


@query(sql(_cards(6), *_ALL))
def report_kpis_dashboard(spark, sf):
    return rounded(R.kpis(_run(spark, sf), dashboard=True), "value")


@query(sql("SELECT level, count(*) AS count, printf('%.1f', count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()) AS percent FROM servicing GROUP BY level"))
def report_levels(spark, sf):
    return R.level_table(S.level_distribution(I.servicing_entries(spark, sf)))


_TOP_EVENTS = """SELECT CAST(row_number() OVER (ORDER BY count DESC, event_id) AS INTEGER) AS rank, template[1:{cut}] AS template, count,
 printf('%.1f', frequency_pct) AS percent{more} FROM stats ORDER BY count DESC, event_id LIMIT 10"""


@query(sql(_TOP_EVENTS.format(cut=60, more=""), _STATS))
def report_top_events(spark, sf):
    return R.top_events_table(S.template_stats(I.gapped(spark, sf)))


@query(sql(_TOP_EVENTS.format(cut=80, more=", strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen"), _STATS))
def report_top_events_long(spark, sf):
    return R.top_events_table(S.template_stats(I.gapped(spark, sf)), cut=80, with_times=True)


_WINDOWS = """SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, count, printf('%.1f', count_zscore) AS zscore, {what}
 FROM readings ORDER BY readings.timestamp LIMIT {n}"""


@query(sql(_WINDOWS.format(what="interpretation", n=10), *_SERIES))
def report_anomaly_windows(spark, sf):
    return R.anomaly_table(W.anomaly_windows(I.gapped(spark, sf)))


@query(sql(_WINDOWS.format(what="interpretation", n=20), *_SERIES))
def report_anomaly_windows_dashboard(spark, sf):
    return R.anomaly_table(W.anomaly_windows(I.gapped(spark, sf)), 20)


@query(sql(_WINDOWS.format(what="replace(replace(replace(anomaly_type, '_burst', ''), '_drop', '↓'), '+', '/')[1:20] AS type", n=10), *_SERIES))
def report_anomaly_types(spark, sf):
    return R.anomaly_type_table(W.anomaly_windows(I.gapped(spark, sf)))


@query(sql("""SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, event_id, template[1:50] AS template, count_in_window || 'x' AS repeats
 FROM bursts ORDER BY bursts.timestamp, event_id LIMIT 10""", *_ALL))
def report_bursts(spark, sf):
    return R.burst_table(B.repetition_bursts(I.gapped(spark, sf), 3, 600))


@query(sql("""SELECT template_idx, template[1:60] AS template, printf('%.3f', distance) AS distance, severity FROM semantic
 ORDER BY semantic.distance DESC, template_idx LIMIT 10""", *_ALL))
def report_semantic_anomalies(spark, sf):
    return R.semantic_table(E.semantic_anomalies(E.dense_distances(I.vectors(spark, sf)), 0.8))


@query(sql("""SELECT label AS cluster_id, count(*) AS size, printf('%.1f', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM embeddings)) AS percent,
 arg_min('vector ' || vec_id, vec_id) AS sample FROM embeddings GROUP BY label ORDER BY size DESC, cluster_id LIMIT 5"""))
def report_clusters(spark, sf):
    members = I.vectors(spark, sf).select("template_idx", "template", F.col("label").alias("cluster"))
    return R.cluster_table(S.cluster_summary(members))


@query(sql("SELECT timestamp, count AS total, error_count FROM grid", *_SERIES))
def report_timeline(spark, sf):
    return R.timeline(W.time_series(I.gapped(spark, sf)))


@query(sql("SELECT component, count(*) AS count FROM gapped GROUP BY component ORDER BY count DESC, component LIMIT 10"))
def report_components(spark, sf):
    return R.component_panel(I.gapped(spark, sf))


@query(sql("SELECT CAST(row_number() OVER (ORDER BY count DESC, event_id) - 1 AS INTEGER) AS rank, count FROM stats ORDER BY count DESC, event_id LIMIT 20", _STATS))
def report_count_profile(spark, sf):
    return R.count_profile(S.template_stats(I.gapped(spark, sf)))


@query()
def report_markdown(spark, sf):
    """The whole run, mining included, down to the Markdown lines."""
    return R.markdown_report(A.analyze(I.entries(spark, sf), "events"))


@query()
def report_markdown_legacy(spark, sf):
    return R.markdown_report(A.analyze(I.entries(spark, sf), "events", threshold=3.0), "legacy")


@query()
def report_text(spark, sf):
    return R.text_report(A.analyze(I.entries(spark, sf), "events"))
