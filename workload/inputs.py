"""Log views derived from the test tables, once for Spark and once as SQL."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.numbering import cut_lineage
from logloom.operators.semantics import dense_vectors
from logloom.operators.templates import masked_template_ids
from logloom.sources.parsers import parse_servicing, parse_syslog

YEAR = 2024
TASK_ROWS = 50_000
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "for", "on", "with", "by", "at", "as", "be", "it")

_MESSAGE = """case event_type when 'error' then 'request FAILED for' when 'signup' then 'WARNING slow signup by'
 else concat(event_type, ' accepted from') end, ' user ', user_id, ' at 10.0.0.', user_id % 256"""
_VALUES = """ ' path /v1/', event_type, ' cost ', cast(cast(value as decimal(18,2)) as string),
 ' key ', get_json_object(props, '$.k')"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, spread before any text work: one small file is one task, and a row of numbers grows into a line of text.

    A task gets ``TASK_ROWS`` rows at most, so that it takes as long whatever the size of the table.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def log_syslog(spark: SparkSession, folder: str, suffix: str = "''") -> DataFrame:
    text = f"""concat(date_format(ts, 'MMM dd HH:mm:ss'), ' host', user_id % 4, ' ', event_type, '[', user_id, ']: ',
        {_MESSAGE}, {_VALUES}, {suffix})"""
    return table(spark, folder, "events").select((F.col("event_id") + 1).alias("line"), F.expr(text).alias("text"))


def log_cbs(spark: SparkSession, folder: str) -> DataFrame:
    text = f"""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ', ', 'Info', '      ', upper(event_type), '    ',
        {_MESSAGE}, case when event_id % 7 = 0 then ' HRESULT = 0x800f080d' else ' ok' end)"""
    return table(spark, folder, "events").select((F.col("event_id") + 1).alias("line"), F.expr(text).alias("text"))


# One word more than wildcards can cover between kinds: each kind is one event.
COMPACT = "concat(' status ', event_type, ' ', event_type, ' done ok')"


def entries(spark: SparkSession, folder: str, suffix: str = "''") -> DataFrame:
    return parse_syslog(log_syslog(spark, folder, suffix), YEAR)


def servicing_entries(spark: SparkSession, folder: str) -> DataFrame:
    return parse_servicing(log_cbs(spark, folder))


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with masked-template ids, stored once and then read by column."""
    return cut_lineage(masked_template_ids(entries(spark, folder)), "tagged")


def gapped(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every tenth timestamp missing."""
    return tagged(spark, folder).withColumn("timestamp", F.when(F.col("line") % 10 != 1, F.col("timestamp")))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-blank line of every document, whole, as ``(doc_id, pos, text)``."""
    parts = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return parts.filter(F.col("text").rlike(r"(?U)\S")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text")


def doc_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("template_idx"), F.col("text").alias("template"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "embeddings").withColumn("name", F.concat(F.lit("vector "), F.col("vec_id")))
    return dense_vectors(named, "vec_id", "embedding", "name").join(
        named.select(F.col("vec_id").alias("template_idx"), "label"), "template_idx"
    )


# ---- the same views as SQL text ------------------------------------------------

# The line, token and word patterns of the log formats, repeated here so that
# the SQL does not depend on the package that it checks.

SYSLOG_RE = r"^(\w{3})\s+(\d{1,2})\s(\d{2}:\d{2}:\d{2})\s(\S+)\s([^\[:]+?)(?:\[(\d+)\])?:\s(.*)$"
SERVICING_RE = r"^(\d{4}-\d{2}-\d{2})\s(\d{2}:\d{2}:\d{2})[,\d]*\s+(\w+)\s+(\S+)\s+(.*)$"
VARIABLE_RE = (
    r"<.*>|\d+|0x[0-9a-fA-F]+|(\d{1,3}\.){3}\d{1,3}|[/\\].*"
    r"|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[^@\s]+@[^@\s]+\.[^@\s]+|[\p{L}\p{N}\p{M}_-]+\.[\p{L}\p{N}\p{M}_]{2,}|@.*|[0-9a-fA-F]{40,}"
)
STAMP_RE = r"\d{4}/\d{1,2}/\d{1,2}:\d{2}:\d{2}:\d{2}"
SPACE_RE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD_RE = r"[\p{L}\p{N}\p{M}_]+"


def sql_level(message: str, component: str | None = None, legacy: bool = False) -> str:
    error = r"\b(ERROR|FAILED|FATAL|ALERT|CRITICAL%s)\b" % ("|E_FAIL" if legacy else "")
    info = r"WHEN regexp_matches(upper(%s), '\b(INFO|INFORMATION)\b') THEN 'Info'" % message if legacy else ""
    named = (
        f"WHEN upper({component}) = 'ERROR' THEN 'Error' WHEN upper({component}) = 'WARNING' THEN 'Warning'"
        if component
        else ""
    )
    return rf"""CASE WHEN regexp_matches(upper({message}), '{error}') THEN 'Error'
 WHEN regexp_matches(upper({message}), '\b(WARN|WARNING)\b') THEN 'Warning' {info}
 WHEN regexp_matches({message}, 'HRESULT\s*=\s*0x8[0-9a-fA-F]{{7}}') THEN 'Error' {named} ELSE 'Info' END"""


def sql_tokens(message: str) -> str:
    return (
        f"list_filter(string_split_regex(regexp_replace({message}, '{STAMP_RE}', ' <*> ', 'g'), '{SPACE_RE}'),"
        " lambda t: t <> '')"
    )


def sql_masked(message: str) -> str:
    return (
        f"array_to_string(list_transform({sql_tokens(message)},"
        f" lambda t: CASE WHEN regexp_full_match(t, '{VARIABLE_RE}') THEN '<*>' ELSE t END), ' ')"
    )


_SQL_MESSAGE = """CASE event_type WHEN 'error' THEN 'request FAILED for' WHEN 'signup' THEN 'WARNING slow signup by'
 ELSE event_type || ' accepted from' END || ' user ' || user_id || ' at 10.0.0.' || (user_id % 256)"""
_SQL_VALUES = """' path /v1/' || event_type || ' cost ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
 || ' key ' || json_extract_string(props, '$.k')"""


def _sql_syslog_text(suffix: str) -> str:
    return f"""SELECT event_id + 1 AS line, strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 4) || ' ' || event_type
 || '[' || user_id || ']: ' || {_SQL_MESSAGE} || {_SQL_VALUES} || {suffix} AS text FROM events"""


def _sql_parse_syslog(source: str, legacy: bool = False) -> str:
    return f"""SELECT line, CASE WHEN hit THEN try_strptime('{YEAR} ' || g.mon || ' ' || g.d || ' ' || g.t, '%Y %b %d %H:%M:%S') END AS timestamp,
 CASE WHEN hit THEN {sql_level("trim(g.msg)", "g.prog", legacy)} ELSE 'Info' END AS level,
 CASE WHEN hit THEN g.prog ELSE '' END AS component, CASE WHEN hit THEN trim(g.msg) ELSE text END AS message_raw,
 CASE WHEN hit THEN coalesce(g.pid, '') ELSE '' END AS pid, 'linux' AS source
 FROM (SELECT line, text, regexp_matches(text, '{SYSLOG_RE}') AS hit,
 regexp_extract(text, '{SYSLOG_RE}', ['mon', 'd', 't', 'host', 'prog', 'pid', 'msg']) AS g FROM {source})"""


def _sql_parse_servicing(source: str, legacy: bool = False) -> str:
    level = sql_level("trim(g.msg)", "g.comp", legacy)
    return f"""SELECT line, CASE WHEN hit THEN try_strptime(g.d || ' ' || g.t, '%Y-%m-%d %H:%M:%S') END AS timestamp,
 CASE WHEN NOT hit THEN 'Info' WHEN ({level}) IN ('Error', 'Warning') THEN ({level}) ELSE g.lvl END AS level,
 CASE WHEN hit THEN g.comp ELSE '' END AS component, CASE WHEN hit THEN trim(g.msg) ELSE text END AS message_raw,
 '' AS pid, 'windows' AS source
 FROM (SELECT line, text, regexp_matches(text, '{SERVICING_RE}') AS hit,
 regexp_extract(text, '{SERVICING_RE}', ['d', 't', 'lvl', 'comp', 'msg']) AS g FROM {source})"""


@lru_cache
def ctes() -> dict[str, str]:
    """Named views; each may use the ones before it."""
    return {
        "log_syslog": _sql_syslog_text("''"),
        "log_compact": _sql_syslog_text("' status ' || event_type || ' ' || event_type || ' done ok'"),
        "log_cbs": f"""SELECT event_id + 1 AS line, strftime(ts, '%Y-%m-%d %H:%M:%S') || ', Info      ' || upper(event_type)
 || '    ' || {_SQL_MESSAGE} || CASE WHEN event_id % 7 = 0 THEN ' HRESULT = 0x800f080d' ELSE ' ok' END AS text FROM events""",
        "entries": _sql_parse_syslog("log_syslog"),
        "entries_legacy": _sql_parse_syslog("log_syslog", True),
        "entries_compact": _sql_parse_syslog("log_compact"),
        "servicing": _sql_parse_servicing("log_cbs"),
        "servicing_legacy": _sql_parse_servicing("log_cbs", True),
        "masked": f"SELECT *, {sql_masked('message_raw')} AS template FROM entries",
        "numbered": "SELECT template, row_number() OVER (ORDER BY min(line)) AS event_id FROM masked WHERE template <> '' GROUP BY template",
        "tagged": "SELECT m.*, coalesce(n.event_id, 0) AS event_id FROM masked m LEFT JOIN numbered n USING (template)",
        "gapped": "SELECT * REPLACE (CASE WHEN line % 10 <> 1 THEN timestamp END AS timestamp) FROM tagged",
        "doc_lines": r"""SELECT doc_id, pos - 1 AS pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_replace(text, '"""
        + SPACE_RE
        + r"""', '', 'g') <> ''""",
    }


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` under the views it needs, directly or through others."""
    views = {**ctes(), **dict(extra)}
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(views[name])
    used = [f"{name} AS ({views[name]})" for name in views if name in needed]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + body
