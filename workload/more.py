"""Registered queries on written log files, other bin widths, and repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import n_words, spaced_words, words
from logloom.operators import bursts as B
from logloom.operators import templates as T
from logloom.operators import timeseries as W
from logloom.operators.mining_checks import first_fit_violations
from logloom.operators.numbering import cut_lineage, shared_folder
from logloom.sources import detect
from logloom.sources.detect import read_entries
from logloom.sources.lines import read_lines
from logloom.sources.tables import csv_entries, from_table, read_csv
from workload import inputs as I
from workload.inputs import sql
from workload.queries import _FORMAT, _SERIES, _Z, _burst_sql, _shown_top, query, rounded


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/logloom/{name}-{uuid.uuid4().hex}"


def _as_files(lines: DataFrame, name: str, files: int = 4) -> str:
    """The lines in order as text files whose names are in order."""
    path = _folder(lines.sparkSession, name)
    lines.repartitionByRange(files, "line").sortWithinPartitions("line").select("text").write.text(path)
    return path


@query(sql("SELECT row_number() OVER (ORDER BY line) AS line, text FROM log_syslog"))
def raw_lines_numbered(spark, sf):
    """The log as several files, read back under one numbering."""
    return read_lines(spark, _as_files(I.log_syslog(spark, sf), "raw")).select("line", "text")


@query(sql(f"SELECT log, format FROM ({_FORMAT})"))
def detect_format_by_path(spark, sf):
    logs = {"syslog": I.log_syslog(spark, sf), "servicing": I.log_cbs(spark, sf)}
    found = [(name, detect.detect_format(spark, _as_files(log, name))) for name, log in logs.items()]
    return spark.createDataFrame(found, "log string, format string")


_WRITTEN = ("EEE MMM dd HH:mm:ss yyyy", "MMM dd yyyy HH:mm:ss", "yyyyMMdd HH:mm:ss", "MMddyy HHmmss", "yyyy-MM-dd HH:mm:ss")


@query("SELECT event_id + 1 AS line, date_trunc('second', ts) AS timestamp FROM events")
def csv_text_dates(spark, sf):
    """Times as words and as digits."""
    forms = F.element_at(F.array(*[F.date_format("ts", f) for f in _WRITTEN]), (F.col("event_id") % len(_WRITTEN) + 1).cast("int"))
    rows = I.table(spark, sf, "events").select((F.col("event_id") + 1).alias("line"), forms.alias("timestamp"), F.col("event_type").alias("message"))
    return csv_entries(rows).select("line", "timestamp")


@query(sql(f"""SELECT row_number() OVER (ORDER BY event_id) AS line, date_trunc('second', ts) AS timestamp, {I._SQL_MESSAGE} || ', "quoted"' AS message_raw FROM events"""))
def csv_file_entries(spark, sf):
    """A folder of CSV files whose own line numbers start anew in each file."""
    rows = I.table(spark, sf, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    rows = rows.select(
        (F.monotonically_increasing_id() % (1 << 33) + 1).alias("LineId"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.concat(F.expr(f"concat({I._MESSAGE})"), F.lit(', "quoted"')).alias("Content"),
    )
    path = _folder(spark, "csv")
    rows.write.csv(path, header=True, escape='"')
    return read_csv(spark, path, multi_line=False).select("line", "timestamp", "message_raw")


# ---- bins that do not divide a day, short series -------------------------------------


def _other_bins(minutes: int, width: int | None = None) -> tuple:
    """The series views at another bin width; bins start at midnight of the first day."""
    origin = "(SELECT date_trunc('day', min(timestamp)) FROM gapped)"
    out = []
    for name, body in _SERIES:
        body = body.replace("time_bucket(INTERVAL 5 MINUTE, timestamp)", f"time_bucket(INTERVAL {minutes} MINUTE, timestamp, {origin})")
        body = body.replace("INTERVAL 5 MINUTE", f"INTERVAL {minutes} MINUTE").replace("events in 5min", f"events in {minutes}min")
        out.append((name, body if width is None else body.replace("9 PRECEDING", f"{width - 1} PRECEDING")))
    return tuple(out)


_READINGS = f"SELECT timestamp, count, {_Z}, anomaly_type, top_events, interpretation FROM readings"


def _readings(spark, sf, minutes):
    out = _shown_top(W.anomaly_windows(I.gapped(spark, sf), minutes))
    return rounded(out, "count_zscore", "unique_zscore", "global_zscore")


@query(sql(_READINGS, *_other_bins(7)))
def anomaly_windows_7_minutes(spark, sf):
    return _readings(spark, sf, 7)


@query(sql("SELECT timestamp, count AS total, n_unique AS unique_templates, error_count, warning_count FROM grid", *_other_bins(7)))
def time_series_7_minutes(spark, sf):
    return W.time_series(I.gapped(spark, sf), 7)


@query(sql("""SELECT timestamp, count, round(ma, 6) AS ma, round(sd, 6) AS std, round((count - ma) / (sd + 1e-8), 6) AS zscore FROM roll
 WHERE (count - ma) / (sd + 1e-8) > 2.5""", *_other_bins(7)))
def volume_bursts_7_minutes(spark, sf):
    return rounded(W.volume_bursts(I.gapped(spark, sf), 7, threshold=2.5), "ma", "std", "zscore")


# Bins of two days: the log of a month has few of them, so the rolling width is a fifth of their number.
_FEW = 2880


@query(sql("SELECT timestamp, count, round(ma, 6) AS count_ma, round(sd, 6) AS count_std FROM roll", *_other_bins(_FEW, 3)))
def rolling_width_of_a_short_series(spark, sf):
    binned = W.binned_counts(I.gapped(spark, sf), _FEW)
    width = W.adaptive_width(W.bin_span(binned))
    series = W.filled(binned, _FEW).select("bin", "timestamp", "count")
    return rounded(W.rolling(series, ["count"], width).drop("bin"), "count_ma", "count_std")


# ---- repeats at the default thresholds -------------------------------------------------

_HOURLY = ("hourly", "SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM gapped")


@query(sql(_burst_sql(10, 5).replace("gapped", "hourly"), _HOURLY))
def repetition_bursts_of_hourly_stamps(spark, sf):
    """Stamps cut to the hour, as loggers with coarse clocks write them, so that events repeat within ten seconds."""
    rows = I.gapped(spark, sf).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return B.repetition_bursts(rows)


# ---- what must hold for every mined log ---------------------------------------------------


def _mining_checks(entries: DataFrame, mined) -> DataFrame:
    """Counts, and violations of each rule of similarity mining, which must all be zero."""
    # Stored: the templates are read three times.
    rows = cut_lineage(T.attach_templates(entries, mined), "attached", T.TEXTS)
    said, shape = F.col("said"), F.split("template", " ")
    # A message that is its template, as most rows of a log of distinct lines are, agrees with it word by word.
    same = said.eqNullSafe(F.col("template"))
    pairs = F.zip_with(words(said), shape, lambda a, b: (b != "<*>") & (a != b))
    wild = F.when(F.contains("template", F.lit("<*>")), F.size(F.filter(shape, lambda w: w == "<*>"))).otherwise(0) / F.size(shape)
    # First lines are numbers, summed up without a sort; only the rows that stand there bring their texts.
    founded = cut_lineage(rows.groupBy(F.col("event_id").alias("of")).agg(F.min("line").alias("founded")), "founded")
    at = [rows["event_id"] == founded["of"], rows["line"].eqNullSafe(founded["founded"])]
    events = rows.join(founded, at).select("event_id", "founded", F.col("template").alias("first"), spaced_words(F.col("message_raw")).alias("founder"))
    # Every event must be founded later than the one numbered before it.
    order = events.join(events.select((F.col("event_id") + 1).alias("event_id"), F.col("founded").alias("before")), "event_id", "left")
    found = order.agg(
        F.count_if(F.col("before") >= F.col("founded")).alias("misnumbered"),
        F.count_if(F.col("before").isNull() & (F.col("event_id") != 1)).alias("gaps"),
        F.count_if(F.col("first") != F.col("founder")).alias("unfounded"),
    )
    lines = rows.withColumn("said", spaced_words(F.col("message_raw"))).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("event_id") == 0).alias("without_event"),
        F.count_if(n_words(said) != F.size(shape)).alias("other_length"),
        F.count_if(~same & F.exists(pairs, lambda x: x)).alias("other_word"),
        F.count_if(1 - wild < 0.75).alias("too_general"),
    )
    one = F.lit(1).alias("one")
    replayed = first_fit_violations(entries, mined)
    return lines.select(one, "*").join(found.select(one, "*"), "one").join(replayed.select(one, "*"), "one").drop("one")


_NONE = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("without_event", "other_length", "other_word", "too_general", "misnumbered", "gaps", "unfounded", "not_first_fit", "merge_missed", "unassigned"))


@query(f"SELECT count(*) AS lines, {_NONE} FROM events")
def drain_rules(spark, sf):
    """The rules that the templates of the wide log keep."""
    rows = cut_lineage(I.entries(spark, sf), "entries", T.TEXTS)
    return _mining_checks(rows, T.mine_templates(rows))


@query(sql(f"SELECT count(*) AS lines, {_NONE} FROM doc_lines"))
def drain_document_line_rules(spark, sf):
    """The same for the lines of all documents."""
    lines = I.doc_lines(spark, sf).withColumn("k", F.col("doc_id") * 1_000_000 + F.col("pos"))
    rows = cut_lineage(from_table(lines, "text", line="k", source="docs"), "doc-lines", T.TEXTS)
    return _mining_checks(rows, T.mine_templates(rows))


# ---- folders as users have them ----------------------------------------------------------


@query(sql("SELECT line, timestamp, message_raw FROM entries"))
def syslog_folder_of_any_names(spark, sf):
    """Files in folders with blanks and signs in their names, the first of them empty."""
    top = _folder(spark, "logs")
    lines = I.log_syslog(spark, sf)
    lines.limit(0).select("text").coalesce(1).write.text(f"{top}/100% empty")
    whole = lines.repartitionByRange(3, "line").sortWithinPartitions("line").select("text")
    whole.write.text(f"{top}/log of [all] hosts")
    return read_entries(spark, [f"{top}/100% empty", f"{top}/log of \\[all\\] hosts"], I.YEAR).select("line", "timestamp", "message_raw")


@query(sql(f"""SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS line, date_trunc('second', ts) AS timestamp, {I._SQL_MESSAGE} AS message_raw,
 CASE event_id % 2 WHEN 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS pid FROM events"""))
def csv_folders_by_their_headers(spark, sf):
    """CSV files whose columns differ in order and number."""
    top = _folder(spark, "csv")
    stamp, said = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.expr(f"concat({I._MESSAGE})")
    for odd, columns in ((0, [stamp.alias("Timestamp"), said.alias("Content")]), (1, [F.col("user_id").alias("PID"), said.alias("Content"), stamp.alias(" timestamp")])):
        rows = I.table(spark, sf, "events").filter(F.col("event_id") % 2 == odd).repartitionByRange(2, "event_id").sortWithinPartitions("event_id")
        rows.select(*columns).write.csv(f"{top}/half {odd}", header=True, escape='"')
    return read_csv(spark, [f"{top}/half 0", f"{top}/half 1"]).select("line", "timestamp", "message_raw", "pid")


@query(sql(f"""SELECT row_number() OVER (ORDER BY event_id) AS line, date_trunc('second', ts) AS timestamp,
 {I._SQL_MESSAGE} || chr(10) || chr(10) || 'then, "quoted"' || chr(10) AS message_raw FROM events"""))
def csv_records_over_lines(spark, sf):
    """CSV files whose messages have line breaks, blank lines and quotes inside."""
    rows = I.table(spark, sf, "events").repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    said = F.concat(F.expr(f"concat({I._MESSAGE})"), F.lit('\n\nthen, "quoted"\n'))
    path = _folder(spark, "csv")
    rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), said.alias("Content")).write.csv(path, header=True, escape='"', quoteAll=True, ignoreTrailingWhiteSpace=False)
    return read_csv(spark, path).select("line", "timestamp", "message_raw")
