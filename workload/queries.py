"""The registered queries: each a Spark job over whole tables, most with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.text import masked_template, merge_tokens, strip, tokenize
from logloom.operators import bursts as B
from logloom.operators import clustering as C
from logloom.operators import semantics as E
from logloom.operators import similarity as SIM
from logloom.operators import stats as S
from logloom.operators import templates as T
from logloom.operators import timeseries as W
from logloom.operators.numbering import cut_lineage
from logloom.sources.detect import score_format
from logloom.sources.parsers import parse_servicing, parse_syslog
from logloom.sources.tables import csv_entries, from_table
from workload import inputs as I
from workload.inputs import sql
from workload.mining_sql import CATALOGUE, DOCUMENT_LINES, EVENTS, SIZES, VERSIONS, WIDE, mined_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return add


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- sources -------------------------------------------------------------------

_ENTRY = "timestamp, level, component, message_raw, pid, source, line"


@query(sql(f"SELECT {_ENTRY} FROM entries"))
def parse_syslog_lines(spark, sf):
    return I.entries(spark, sf)


@query(sql(f"SELECT {_ENTRY} FROM servicing"))
def parse_servicing_lines(spark, sf):
    return I.servicing_entries(spark, sf)


@query(sql(f"SELECT {_ENTRY.replace('timestamp', 'CAST(NULL AS TIMESTAMP) AS timestamp')} FROM unmatched", (
    "unmatched",
    "SELECT doc_id * 1000000 + pos AS line, 'Info' AS level, '' AS component, regexp_replace(regexp_replace(text, '^' || '"
    + I.SPACE_RE + "', ''), '" + I.SPACE_RE + "$', '') AS message_raw, '' AS pid, 'linux' AS source FROM doc_lines",
)))
def parse_unmatched_lines(spark, sf):
    lines = I.doc_lines(spark, sf)
    return parse_syslog(
        lines.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line"), strip(F.col("text")).alias("text")), I.YEAR
    )


_LEVELS = """SELECT 'syslog' AS log, level, count(*) AS n FROM {a} GROUP BY level
 UNION ALL SELECT 'servicing', level, count(*) FROM {b} GROUP BY level"""


def _levels(spark, sf, ruleset):
    both = parse_syslog(I.log_syslog(spark, sf), I.YEAR, ruleset=ruleset).select(F.lit("syslog").alias("log"), "level")
    other = parse_servicing(I.log_cbs(spark, sf), ruleset).select(F.lit("servicing").alias("log"), "level")
    return both.unionByName(other).groupBy("log", "level").agg(F.count(F.lit(1)).alias("n"))


@query(sql(_LEVELS.format(a="entries", b="servicing")))
def level_inference(spark, sf):
    return _levels(spark, sf, "current")


@query(sql(_LEVELS.format(a="entries_legacy", b="servicing_legacy")))
def level_inference_legacy(spark, sf):
    return _levels(spark, sf, "legacy")


_FORMAT = f"""SELECT log, a AS syslog_hits, b AS servicing_hits, CASE WHEN a > b THEN 'syslog' ELSE 'servicing' END AS format FROM (
 SELECT log, count(*) FILTER (regexp_matches(text, '{I.SYSLOG_RE}')) AS a, count(*) FILTER (regexp_matches(text, '{I.SERVICING_RE}')) AS b
 FROM (SELECT 'syslog' AS log, line, text FROM log_syslog UNION ALL SELECT 'servicing', line, text FROM log_cbs) WHERE line <= 50 GROUP BY log)"""


@query(sql(_FORMAT))
def detect_format(spark, sf):
    one = score_format(I.log_syslog(spark, sf)).withColumn("log", F.lit("syslog"))
    two = score_format(I.log_cbs(spark, sf)).withColumn("log", F.lit("servicing"))
    return one.unionByName(two)


_CSV = """SELECT date_trunc('second', ts) AS timestamp, CASE WHEN first_level IN ('info','warning','error','debug','trace','fatal','critical')
 THEN event_type ELSE {level} END AS level, concat('host', user_id % 4) AS component, {msg} AS message_raw, CAST(user_id AS VARCHAR) AS pid,
 'csv' AS source, event_id + 1 AS line FROM events, (SELECT lower(arg_min(event_type, event_id)) AS first_level FROM events)"""


@query(sql(_CSV.format(level=I.sql_level("(" + I._SQL_MESSAGE + ")"), msg=I._SQL_MESSAGE)))
def csv_table_entries(spark, sf):
    """The CSV rules on a table of strings; its level column holds unknown names unless the first is known."""
    rows = I.table(spark, sf, "events").select(
        (F.col("event_id") + 1).cast("string").alias("LineId"),
        F.date_format("ts", "yyyy-MM-dd").alias(" Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time "),
        F.col("event_type").alias("Level"),
        F.concat(F.lit("host"), F.col("user_id") % 4).alias("Component"),
        F.col("user_id").cast("string").alias("PID"),
        F.expr(f"concat({I._MESSAGE})").alias("Content"),
    )
    return csv_entries(rows)


_TURNS = (
    "turns",
    f"""SELECT conv_id * 1000 + turn AS k, role, text, {I.sql_level('text')} AS level FROM conversations""",
)


@query(sql("""SELECT CAST(NULL AS TIMESTAMP) AS timestamp, level, role AS component, text AS message_raw, '' AS pid, 'chat' AS source,
 row_number() OVER (ORDER BY k) AS line FROM turns""", _TURNS))
def table_entries(spark, sf):
    """Any table as entries, with dense line numbers from its own order."""
    rows = I.table(spark, sf, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return from_table(rows, "text", component="role", order_by="k", source="chat")


# ---- templates -----------------------------------------------------------------


@query(sql(f"SELECT doc_id, pos, {I.sql_masked('text')} AS template, CAST(len({I.sql_tokens('text')}) AS INTEGER) AS n_tokens FROM doc_lines"))
def masked_templates(spark, sf):
    lines = I.doc_lines(spark, sf)
    return lines.select(
        "doc_id", "pos", masked_template(F.col("text")).alias("template"), F.size(tokenize(F.col("text"))).alias("n_tokens")
    )


@query(sql("SELECT line, event_id, template FROM tagged"))
def masked_template_ids(spark, sf):
    return I.tagged(spark, sf).select("line", "event_id", "template")


_MERGE = """SELECT doc_id, pos, array_to_string(list_concat(
 list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END),
 CASE WHEN len(a) > len(b) THEN a[len(b) + 1 : len(a)] ELSE list_transform(range(len(b) - len(a)), lambda i: '<*>') END), ' ') AS merged
 FROM (SELECT doc_id, pos, toks AS a, lead(toks) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM
 (SELECT doc_id, pos, TOKENS AS toks FROM doc_lines)) WHERE b IS NOT NULL"""


@query(sql(_MERGE.replace("TOKENS", I.sql_tokens("text"))))
def template_merge(spark, sf):
    """Each document line merged with the next one of its document."""
    toks = I.doc_lines(spark, sf).select("doc_id", "pos", tokenize(F.col("text")).alias("a"))
    # The next non-blank line need not be pos + 1; documents are at most some thousand lines long.
    pairs = toks.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("pos"))).filter(F.col("b").isNotNull())
    return pairs.select("doc_id", "pos", F.array_join(merge_tokens(F.col("a"), F.col("b")), " ").alias("merged"))


def _drained(spark, sf, suffix="''"):
    rows = cut_lineage(I.entries(spark, sf, suffix), "entries")
    mined = T.mine_templates(rows)
    return T.attach_templates(rows, mined), mined


@query(mined_sql(*WIDE, EVENTS))
def drain_templates(spark, sf):
    return _drained(spark, sf)[0].select("line", "event_id", "template")


@query(mined_sql(*WIDE, VERSIONS))
def drain_versions(spark, sf):
    return T.template_versions(_drained(spark, sf)[1])


@query(mined_sql(*WIDE, CATALOGUE))
def template_catalogue(spark, sf):
    return T.template_catalogue(_drained(spark, sf)[0])


@query(mined_sql(*DOCUMENT_LINES, SIZES))
def drain_document_lines(spark, sf):
    """Similarity templates of all document lines: long, multilingual and mostly distinct."""
    rows = from_table(
        I.doc_lines(spark, sf).withColumn("k", F.col("doc_id") * 1_000_000 + F.col("pos")), "text", line="k", source="docs"
    )
    mined = T.mine_templates(rows)
    return T.attach_templates(rows, mined).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("count"), F.min("line").alias("first_line")
    )


# In the compact log each kind of event is one cluster, and a position becomes a
# wildcard at the first line that differs from the kind's first line there.
_COMPACT = (
    "compact_state",
    f"""SELECT line, component, toks, first_value(toks) OVER (PARTITION BY component ORDER BY line) AS founder,
 min(line) OVER (PARTITION BY component) AS first_line FROM (SELECT line, component, {I.sql_tokens('message_raw')} AS toks FROM entries_compact)""",
)
_COMPACT_POS = (
    "compact_words",
    """SELECT line, component, first_line, i, founder[i] AS word, bool_or(toks[i] <> founder[i]) OVER (PARTITION BY component, i ORDER BY line) AS wild
 FROM compact_state, (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(toks)""",
)
_COMPACT_ROWS = (
    "compact_rows",
    """SELECT line, CAST(dense_rank() OVER (ORDER BY first_line) AS BIGINT) AS event_id, template FROM (SELECT line, first_line,
 string_agg(CASE WHEN wild THEN '<*>' ELSE word END, ' ' ORDER BY i) AS template FROM compact_words GROUP BY line, first_line)""",
)
_COMPACT_ALL = (_COMPACT, _COMPACT_POS, _COMPACT_ROWS)


@query(sql("SELECT line, event_id, template FROM compact_rows", *_COMPACT_ALL))
def drain_compact(spark, sf):
    return _drained(spark, sf, I.COMPACT)[0].select("line", "event_id", "template")


@query(sql("""SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY valid_from) AS version, valid_from,
 lead(valid_from) OVER (PARTITION BY event_id ORDER BY valid_from) AS valid_to, template
 FROM (SELECT event_id, template, min(line) AS valid_from FROM compact_rows GROUP BY event_id, template)""", *_COMPACT_ALL))
def drain_compact_versions(spark, sf):
    return T.template_versions(_drained(spark, sf, I.COMPACT)[1])


@query(sql("""SELECT event_id, arg_max(template, line) AS template, count(*) AS count, min(line) AS first_line
 FROM compact_rows GROUP BY event_id""", *_COMPACT_ALL))
def template_catalogue_compact(spark, sf):
    return T.template_catalogue(_drained(spark, sf, I.COMPACT)[0])


@query(sql("""SELECT row_number() OVER (ORDER BY line) - 1 AS template_idx, event_id, template, line FROM (
 SELECT event_id, template, min(line) AS line FROM compact_rows GROUP BY event_id, template)""", *_COMPACT_ALL))
def distinct_templates(spark, sf):
    return T.distinct_templates(_drained(spark, sf, I.COMPACT)[0])


# ---- statistics and distributions ------------------------------------------------

_STATS = (
    "stats",
    """SELECT event_id, arg_min(template, line) AS template, count(message_raw) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
 count(DISTINCT message_raw) AS unique_messages,
 coalesce(date_diff('second', min(timestamp), max(timestamp)), 0)::DOUBLE AS duration_seconds,
 count(message_raw) * 100.0::DOUBLE / (SELECT count(message_raw) FROM gapped) AS frequency_pct FROM gapped GROUP BY event_id""",
)
_MODES = (
    "modes",
    """SELECT event_id, component AS components FROM (SELECT event_id, component, row_number() OVER
 (PARTITION BY event_id ORDER BY count(*) DESC, component) AS r FROM gapped WHERE component IS NOT NULL GROUP BY event_id, component) WHERE r = 1""",
)


@query(sql("""SELECT event_id, template, count, first_seen, last_seen, unique_messages, components, duration_seconds,
 round(count / (duration_seconds / 3600 + 1), 6) AS rate_per_hour, round(frequency_pct, 6) AS frequency_pct
 FROM stats JOIN modes USING (event_id)""", _STATS, _MODES))
def template_stats(spark, sf):
    return rounded(S.template_stats(I.gapped(spark, sf)), "rate_per_hour", "frequency_pct")


@query(sql("""SELECT event_id, template, count, round(count * 100.0::DOUBLE / (SELECT count(*) FROM gapped), 6) AS problem_ratio
 FROM stats ORDER BY count DESC, event_id LIMIT 3""", _STATS))
def top_problems(spark, sf):
    rows = I.gapped(spark, sf)
    top = S.top_problems(rows, S.template_stats(rows), 3)
    return rounded(top.select("event_id", "template", "count", "problem_ratio"), "problem_ratio")


_SHARE = "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage"


@query(sql(f"SELECT level, count(*) AS count, {_SHARE} FROM servicing GROUP BY level"))
def level_dist(spark, sf):
    return rounded(S.level_distribution(I.servicing_entries(spark, sf)), "percentage")


@query(sql("""SELECT component, count, round(count * 100.0::DOUBLE / sum(count) OVER (), 6) AS percentage FROM (
 SELECT split_part(url, '/', 3) AS component, count(*) AS count FROM pages GROUP BY 1 ORDER BY count DESC, component LIMIT 15)"""))
def component_dist(spark, sf):
    """Host names of the pages as components: more of them than are shown."""
    pages = I.table(spark, sf, "pages")
    rows = from_table(pages, "html", component=F.split_part("url", F.lit("/"), F.lit(3)), line="page_id")
    return rounded(S.component_distribution(rows), "percentage")


@query(sql(f"SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS count, {_SHARE} FROM gapped WHERE timestamp IS NOT NULL GROUP BY 1"))
def hour_dist(spark, sf):
    return rounded(S.hour_distribution(I.gapped(spark, sf)), "percentage")


@query(sql(f"SELECT CAST(coalesce(hour(timestamp), 0) AS INTEGER) AS hour, count(*) AS count, {_SHARE} FROM gapped GROUP BY 1"))
def hour_dist_untimed(spark, sf):
    return rounded(S.hour_distribution(I.gapped(spark, sf), include_untimed=True), "percentage")


_PATTERNS = (
    "patterns",
    """SELECT count(*) AS total_lines, (SELECT count(*) FROM stats) AS unique_events,
 (SELECT template FROM stats ORDER BY count DESC, event_id LIMIT 1) AS top_event,
 (SELECT count FROM stats ORDER BY count DESC, event_id LIMIT 1) AS top_event_count,
 (SELECT frequency_pct FROM stats ORDER BY count DESC, event_id LIMIT 1) AS top_event_pct,
 count(*) FILTER (level = 'Error') AS error_count, count(*) FILTER (level = 'Error') * 100.0::DOUBLE / count(*) AS error_pct,
 count(*) FILTER (level = 'Warning') AS warning_count,
 (SELECT CAST(sum(count) AS DOUBLE) FROM (SELECT count FROM stats ORDER BY count DESC LIMIT 10)) * 100.0::DOUBLE / count(*) AS top10_coverage,
 (SELECT count(*) FROM stats WHERE frequency_pct < 1) AS rare_events_count FROM gapped""",
)
_PATTERN_COLUMNS = """total_lines, unique_events, top_event, top_event_count, round(top_event_pct, 6) AS top_event_pct, error_count,
 round(error_pct, 6) AS error_pct, warning_count, round(top10_coverage, 6) AS top10_coverage, rare_events_count"""


@query(sql(f"SELECT {_PATTERN_COLUMNS} FROM patterns", _STATS, _PATTERNS))
def pattern_summary(spark, sf):
    rows = I.gapped(spark, sf)
    out = S.pattern_summary(rows, S.template_stats(rows))
    return rounded(out, "top_event_pct", "error_pct", "top10_coverage")


# ---- time ------------------------------------------------------------------------

_BINS = (
    "bins",
    """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, count(message_raw) AS count, count(DISTINCT event_id) AS n_unique,
 count(*) FILTER (level = 'Error') AS error_count, count(*) FILTER (level = 'Warning') AS warning_count
 FROM gapped WHERE timestamp IS NOT NULL GROUP BY 1""",
)
_GRID = (
    "grid",
    """SELECT t.timestamp, coalesce(count, 0) AS count, coalesce(n_unique, 0) AS n_unique, coalesce(error_count, 0) AS error_count,
 coalesce(warning_count, 0) AS warning_count FROM (SELECT unnest(generate_series((SELECT min(timestamp) FROM bins),
 (SELECT max(timestamp) FROM bins), INTERVAL 5 MINUTE)) AS timestamp) t LEFT JOIN bins USING (timestamp)""",
)
_ROLL = (
    "roll",
    """SELECT timestamp, count, n_unique, avg(count) OVER w AS ma, coalesce(stddev_samp(count) OVER w, 0) AS sd,
 avg(n_unique) OVER w AS uma, coalesce(stddev_samp(n_unique) OVER w, 0) AS usd
 FROM grid WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
_SCORES = (
    "scores",
    """SELECT timestamp, count, n_unique, (count - ma) / (sd + 1e-8) AS count_zscore, (n_unique - uma) / (usd + 1e-8) AS unique_zscore,
 (count - (SELECT avg(count) FROM grid)) / ((SELECT stddev_samp(count) FROM grid) + 1e-8) AS global_zscore FROM roll""",
)


def _kind(c, n, th):
    return f"CASE WHEN {c} > {th} THEN '{n}_burst' WHEN {c} < -{th} THEN '{n}_drop' END"


def _found(th):
    kinds = ", ".join(_kind(c, n, th) for c, n in (("count_zscore", "volume"), ("unique_zscore", "diversity"), ("global_zscore", "global")))
    return f"""SELECT *, coalesce(nullif(concat_ws('+', {kinds}), ''), 'unknown') AS anomaly_type FROM scores
 WHERE abs(count_zscore) > {th} OR abs(unique_zscore) > {th} OR abs(global_zscore) > {1.5 * th}"""


_FOUND = ("found", _found(2.5))
_TOP = (
    "top3",
    """SELECT timestamp, event_id, n, template, r FROM (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, event_id, count(*) AS n,
 arg_min(template, line)[1:40] AS template, row_number() OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, timestamp) ORDER BY count(*) DESC, event_id) AS r
 FROM gapped WHERE timestamp IS NOT NULL GROUP BY 1, 2) WHERE r <= 3""",
)
_TOP_TEXT = (
    "top_text",
    """SELECT timestamp, string_agg(n || 'x ' || template, ' ; ' ORDER BY r) AS top_events,
 string_agg('"' || template || '" (' || n || 'x)', ', ' ORDER BY r) FILTER (r <= 2) AS top_two FROM top3 GROUP BY timestamp""",
)
_READ = (
    "readings",
    """SELECT f.*, coalesce(top_events, '') AS top_events, coalesce(nullif(concat_ws(' + ',
 CASE WHEN contains(anomaly_type, 'volume_burst') THEN 'volume burst (' || count || ' events in 5min)' END,
 CASE WHEN contains(anomaly_type, 'diversity_burst') THEN 'event diversity spike' END,
 CASE WHEN contains(anomaly_type, 'global_burst') THEN 'global outlier' END,
 CASE WHEN contains(anomaly_type, 'drop') THEN 'activity drop' END), ''), 'anomalous pattern')
 || coalesce('. Top: ' || top_two, '') AS interpretation FROM found f LEFT JOIN top_text USING (timestamp)""",
)
_SERIES = (_BINS, _GRID, _ROLL, _SCORES, _FOUND, _TOP, _TOP_TEXT, _READ)
_Z = "round(count_zscore, 6) AS count_zscore, round(unique_zscore, 6) AS unique_zscore, round(global_zscore, 6) AS global_zscore"


def _shown_top(df):
    return df.withColumn(
        "top_events",
        F.array_join(
            F.transform("top_events", lambda e: F.concat(e["count"].cast("string"), F.lit("x "), e["template"])), " ; "
        ),
    )


@query(sql("SELECT timestamp, count AS total, n_unique AS unique_templates, error_count, warning_count FROM grid", *_SERIES))
def time_series(spark, sf):
    return W.time_series(I.gapped(spark, sf))


@query(sql("""SELECT line, CAST(coalesce(hour(timestamp), 0) AS INTEGER) AS hour, CAST(coalesce(isodow(timestamp) - 1, 0) AS INTEGER) AS day_of_week,
 CASE WHEN timestamp IS NULL THEN 0 ELSE r END AS window_id FROM (SELECT line, timestamp,
 dense_rank() OVER (ORDER BY time_bucket(INTERVAL 5 MINUTE, timestamp) NULLS LAST) AS r FROM gapped)"""))
def temporal_features(spark, sf):
    return W.temporal_features(I.gapped(spark, sf)).select("line", "hour", "day_of_week", "window_id")


@query(sql("""SELECT timestamp, count, round(ma, 6) AS count_ma, round(sd, 6) AS count_std, round(uma, 6) AS n_unique_ma,
 round(usd, 6) AS n_unique_std FROM roll""", *_SERIES))
def rolling_statistics(spark, sf):
    series = W.filled(W.binned_counts(I.gapped(spark, sf))).select("bin", "timestamp", "count", "n_unique")
    out = W.rolling(series, ["count", "n_unique"], 10).drop("bin", "n_unique")
    return rounded(out, "count_ma", "count_std", "n_unique_ma", "n_unique_std")


@query(sql(f"SELECT timestamp, count, n_unique, {_Z} FROM scores", *_SERIES))
def rolling_and_global_z(spark, sf):
    series = W.filled(W.binned_counts(I.gapped(spark, sf)))
    return rounded(W.scored_series(series, 10).drop("bin"), "count_zscore", "unique_zscore", "global_zscore")


@query(sql(f"SELECT timestamp, count, {_Z}, anomaly_type, top_events, interpretation FROM readings", *_SERIES))
def anomaly_windows(spark, sf):
    out = _shown_top(W.anomaly_windows(I.gapped(spark, sf)))
    return rounded(out, "count_zscore", "unique_zscore", "global_zscore")


@query(sql(f"SELECT timestamp, count, {_Z}, anomaly_type FROM found", *[v for v in _SERIES if v[0] != "found"], ("found", _found(3.0))))
def legacy_anomalies(spark, sf):
    out = W.anomaly_windows(I.gapped(spark, sf), threshold=3.0, with_top=False)
    return rounded(out, "count_zscore", "unique_zscore", "global_zscore")


_VOLUME = """SELECT timestamp, count, round(ma, 6) AS ma, round(sd, 6) AS std, round((count - ma) / (sd + 1e-8), 6) AS zscore FROM roll
 WHERE (count - ma) / (sd + 1e-8) > {}"""


@query(sql(_VOLUME.format(2.5), *_SERIES))
def volume_bursts(spark, sf):
    return rounded(W.volume_bursts(I.gapped(spark, sf), threshold=2.5), "ma", "std", "zscore")


@query(sql(_VOLUME.format(3), *_SERIES))
def volume_bursts_default(spark, sf):
    return rounded(W.volume_bursts(I.gapped(spark, sf)), "ma", "std", "zscore")


@query(sql("SELECT timestamp, top_events FROM top_text", *_SERIES))
def top_events_per_window(spark, sf):
    top = W.top_events(I.gapped(spark, sf))
    return _shown_top(top).select(W.bin_start(F.col("bin"), 5).alias("timestamp"), "top_events")


# The same series analytics on a table that is no log: orders per day.
@query(sql("""SELECT t.day AS timestamp, coalesce(n, 0) AS total, coalesce(u, 0) AS unique_templates, 0::BIGINT AS error_count, 0::BIGINT AS warning_count FROM
 (SELECT unnest(generate_series((SELECT date_trunc('day', min(o_orderdate)) FROM orders), (SELECT date_trunc('day', max(o_orderdate)) FROM orders),
 INTERVAL 1 DAY)) AS day) t LEFT JOIN (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders
 GROUP BY 1) d ON t.day = d.day"""))
def orders_per_day(spark, sf):
    orders = I.table(spark, sf, "orders")
    rows = from_table(orders, "o_orderstatus", timestamp="o_orderdate", level=F.lit("Info"), line="o_orderkey")
    return W.time_series(rows.withColumn("event_id", F.ascii("message_raw")), 1440)


# ---- bursts ------------------------------------------------------------------------


def _burst_sql(seconds, repeats, own=""):
    return f"""SELECT t.timestamp, e.event_id, l.template, count(*) AS count_in_window, {seconds} AS window_seconds
 FROM (SELECT DISTINCT timestamp{own} FROM gapped WHERE timestamp IS NOT NULL) t JOIN gapped e
 ON e.timestamp >= t.timestamp - INTERVAL {seconds} SECOND AND e.timestamp <= t.timestamp {"AND e.event_id = t.event_id" if own else ""}
 JOIN (SELECT event_id, arg_max(template, line) AS template FROM gapped GROUP BY event_id) l ON l.event_id = e.event_id
 GROUP BY 1, 2, 3 HAVING count(*) >= {repeats}"""


@query(sql(_burst_sql(600, 3)))
def repetition_bursts(spark, sf):
    return B.repetition_bursts(I.gapped(spark, sf), 3, 600)


@query(sql(_burst_sql(10, 5)))
def repetition_bursts_default(spark, sf):
    return B.repetition_bursts(I.gapped(spark, sf))


@query(sql(_burst_sql(3600, 4, ", event_id")))
def repetition_bursts_own(spark, sf):
    return B.repetition_bursts(I.gapped(spark, sf), 4, 3600, own_event_only=True)


# ---- vectors -----------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in I.STOP_WORDS)
_TFIDF = (
    ("words", f"""SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{I.WORD_RE}')) AS w FROM documents) WHERE w NOT IN ({_STOP})"""),
    ("vocabulary", "SELECT w FROM words GROUP BY w ORDER BY count(*) DESC, w LIMIT 500"),
    ("tf", "SELECT doc_id, w, count(*) AS tf FROM words SEMI JOIN vocabulary USING (w) GROUP BY doc_id, w"),
    ("idf", "SELECT w, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY w"),
    ("raw_weights", "SELECT doc_id, w, tf * idf AS x FROM tf JOIN idf USING (w)"),
    ("weights", "SELECT doc_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw_weights"),
    ("term_means", "SELECT w, sum(weight) / (SELECT count(*) FROM documents) AS m FROM weights GROUP BY w"),
    ("text_distances", """SELECT d.doc_id AS template_idx, d.text AS template, 1 - coalesce(s, 0) AS distance FROM documents d LEFT JOIN
 (SELECT doc_id, sum(weight * m) / (SELECT sqrt(sum(m * m)) FROM term_means) AS s FROM weights JOIN term_means USING (w) GROUP BY doc_id) USING (doc_id)"""),
)


@query(sql("SELECT doc_id AS template_idx, w AS term, round(weight, 6) AS weight FROM weights", *_TFIDF))
def tfidf_weights(spark, sf):
    return rounded(E.tfidf(I.doc_texts(spark, sf), I.STOP_WORDS), "weight")


_SEVERE = "CASE WHEN distance > 1.5 * {t} THEN 'high' ELSE 'medium' END AS severity"


@query(sql(f"SELECT template_idx, template, round(distance, 6) AS distance, {_SEVERE.format(t=0.4)} FROM text_distances WHERE distance > 0.4", *_TFIDF))
def semantic_anomalies_tfidf(spark, sf):
    texts = I.doc_texts(spark, sf)
    weights = cut_lineage(E.tfidf(texts, I.STOP_WORDS), "weights")
    return rounded(E.semantic_anomalies(E.sparse_distances(weights, texts)), "distance")


_VECTORS = (
    ("comps", """SELECT vec_id, label, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM (SELECT vec_id, label,
 unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""),
    ("center", "SELECT i, m / sqrt(sum(m * m) OVER ()) AS c FROM (SELECT i, avg(v) AS m FROM comps GROUP BY i)"),
    ("distances", "SELECT vec_id AS template_idx, 'vector ' || vec_id AS template, 1 - sum(v * c) AS distance FROM comps JOIN center USING (i) GROUP BY vec_id"),
    ("own_center", "SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM (SELECT label, i, avg(v) AS m FROM comps GROUP BY label, i)"),
    ("pairs", """SELECT idx_a, idx_b, sum(x * y) AS similarity FROM (SELECT a.vec_id AS idx_a, b.vec_id AS idx_b, unnest(a.e) AS x, unnest(b.e) AS y FROM unit_vectors a
 JOIN unit_vectors b ON a.vec_id < b.vec_id) GROUP BY idx_a, idx_b"""),
    ("unit_vectors", "SELECT vec_id, list(v ORDER BY i) AS e FROM comps GROUP BY vec_id"),
)
# Views are used in order, so the unit vectors precede the pairs.
_VECTORS = (*_VECTORS[:4], _VECTORS[5], _VECTORS[4])


@query(sql("SELECT template_idx, round(distance, 6) AS distance, distance > 1.0 AS is_outlier FROM distances", *_VECTORS))
def embedding_outliers(spark, sf):
    out = E.semantic_outliers(E.dense_distances(I.vectors(spark, sf)), 1.0)
    return rounded(out.select("template_idx", "distance", "is_outlier"), "distance")


@query(sql(f"SELECT template_idx, template, round(distance, 6) AS distance, {_SEVERE.format(t=0.8)} FROM distances WHERE distance > 0.8", *_VECTORS))
def semantic_anomalies_dense(spark, sf):
    return rounded(E.semantic_anomalies(E.dense_distances(I.vectors(spark, sf)), 0.8), "distance")


@query(sql("SELECT vec_id AS template_idx, label, round(1 - sum(v * c), 6) AS distance FROM comps JOIN own_center USING (label, i) GROUP BY vec_id, label", *_VECTORS))
def centroid_by_label(spark, sf):
    return rounded(E.label_distances(I.vectors(spark, sf)).select("template_idx", "label", "distance"), "distance")


@query(sql("""SELECT idx_a, idx_b, round(similarity, 6) AS similarity, 1::BIGINT AS copies_a, 1::BIGINT AS copies_b FROM pairs WHERE 1 - similarity <= 0.65""", *_VECTORS))
def cosine_pairs(spark, sf):
    return rounded(SIM.cosine_pairs(I.vectors(spark, sf), 0.65), "similarity")


@query(sql("""SELECT idx, other, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY similarity DESC, other) AS rank
 FROM (SELECT idx_a AS idx, idx_b AS other, similarity FROM pairs UNION ALL SELECT idx_b, idx_a, similarity FROM pairs)) WHERE rank <= 3""", *_VECTORS))
def nearest_vectors(spark, sf):
    return rounded(SIM.nearest_vectors(I.vectors(spark, sf), 3), "similarity")


# ---- clusters ----------------------------------------------------------------------


@query(sql("""SELECT n, CAST(greatest(2, least(least(greatest(2, floor(sqrt(n / 2.0))), 15, n), n - 1)) AS INTEGER) AS k FROM (SELECT count(*) AS n FROM embeddings)"""))
def kmeans_k(spark, sf):
    n = I.table(spark, sf, "embeddings").count()
    counted = I.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("k", F.lit(C.choose_k(n)))


@query()
def kmeans_clusters(spark, sf):
    return C.kmeans(I.vectors(spark, sf))


_DENSITY = (
    ("edges", "SELECT idx_a AS u, idx_b AS v FROM pairs WHERE 1 - similarity <= 0.6 UNION SELECT idx_b, idx_a FROM pairs WHERE 1 - similarity <= 0.6"),
    ("reach", "SELECT u AS node, v AS other FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u"),
    ("roots", "SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node"),
)


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(sql("""SELECT vec_id AS template_idx, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY root NULLS LAST) - 1 END AS cluster
 FROM embeddings LEFT JOIN roots ON node = vec_id""", *_VECTORS, *_DENSITY)))
def density_clusters(spark, sf):
    return C.dbscan(I.vectors(spark, sf), eps=0.6)


@query(sql("SELECT vec_id AS template_idx, -1::BIGINT AS cluster FROM embeddings WHERE vec_id NOT IN (SELECT idx_a FROM pairs WHERE 1 - similarity <= 0.3)", *_VECTORS))
def density_clusters_default(spark, sf):
    return C.dbscan(I.vectors(spark, sf))


@query()
def density_clusters_borders(spark, sf):
    """With borders: five in reach make a core point."""
    return C.dbscan(I.vectors(spark, sf), eps=0.7, min_samples=5)


@query()
def hierarchical_clusters(spark, sf):
    return C.hierarchical(I.vectors(spark, sf))


@query(sql("""SELECT label AS cluster_id, count(*) AS size, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage,
 arg_min('vector ' || vec_id, vec_id) AS sample FROM embeddings GROUP BY label"""))
def cluster_summary(spark, sf):
    members = I.vectors(spark, sf).select("template_idx", "template", F.col("label").alias("cluster"))
    return rounded(S.cluster_summary(members), "percentage")
