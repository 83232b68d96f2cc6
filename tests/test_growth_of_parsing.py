"""Parsing whose cost must not outgrow the input."""

import random

from pyspark.sql import functions as F

from logloom.functions.patterns import BLANKS, UNEVEN_BLANKS
from logloom.sources.parsers import parse_syslog
from workload import inputs


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "event_id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(inputs, "TASK_ROWS", 10)
    df = inputs.table(spark, str(tmp_path), "events")
    assert df.rdd.getNumPartitions() == 100
    assert df.agg(F.count("event_id"), F.sum("event_id")).first() == (1000, 499500)


def test_a_line_is_rewritten_to_its_groups_once(spark):
    lines = spark.createDataFrame([(1, "Jan  2 03:04:05 host app[7]: said\x01so"), (2, "Jan  2 03:04:05 host app: x"), (3, None)], "line bigint, text string")
    parsed = parse_syslog(lines, 2024)
    assert [r["message_raw"] for r in parsed.orderBy("line").collect()] == ["said\x01so", "x", None]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$1\x01$2") == 1


def test_uneven_blanks_are_all_blanks_but_single_spaces(spark):
    rng = random.Random(3)
    blanks = "  \t\n\x1c\x1f\x85\xa0 　"
    texts = ["".join(rng.choice(blanks + "ab") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = F.regexp_replace("t", BLANKS, " ") == F.regexp_replace("t", UNEVEN_BLANKS, " ")
    assert df.filter(~same).isEmpty()
