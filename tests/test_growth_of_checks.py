"""Checks of mining whose cost must not outgrow the input."""

import re

from pyspark.sql import functions as F

from logloom.functions import patterns
from logloom.functions.text import n_literal_wildcards, n_words, spaced_words
from logloom.operators import mining_checks
from logloom.operators.templates import mine_templates
from tests.test_template_mining import W, frame
from workload import more


def test_replay_keeps_an_array_one_row(spark, monkeypatch):
    texts = [f"common words of user u{i} in room r{i // 5} here" for i in range(40)]
    df = frame(spark, texts)
    mined = mine_templates(df)
    monkeypatch.setattr(mining_checks, "cut_lineage", lambda rows, name: rows)
    checked = mining_checks.first_fit_violations(df, mined)
    assert checked.first().asDict() == {"not_first_fit": 0, "merge_missed": 0, "unassigned": 0}
    assert "max_by" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_founders_are_found_without_sorting_texts(spark):
    df = frame(spark, [f"common words of user u{i} here" for i in range(30)] + ["other", "other"])
    checked = more._mining_checks(df, mine_templates(df))
    assert "min_by" not in checked._jdf.queryExecution().optimizedPlan().toString()
    found = checked.first().asDict()
    assert found.pop("lines") == 32 and not any(found.values())


def test_words_of_a_line_are_searched_once(spark, monkeypatch):
    df = frame(spark, [f"common words of user u{i} here" for i in range(20)] + [f"{W} {W} c d", "", "x y"])
    mined, plans, keep = mine_templates(df), {}, mining_checks.cut_lineage

    def stored(rows, name):
        plans[name] = rows._jdf.queryExecution().optimizedPlan().toString()
        return keep(rows, name)

    monkeypatch.setattr(mining_checks, "cut_lineage", stored)
    assert not any(mining_checks.first_fit_violations(df, mined).first())
    assert plans["checked"].count("{2,}|") == 1


def test_letters_of_any_language_need_no_search_for_blanks(spark):
    blank = re.compile(patterns._BLANK)
    assert patterns.ODD_BLANKS == [chr(c) for c in range(0x10000) if chr(c) != " " and blank.match(chr(c))]
    texts = ["", "a", f"{W} b {W} x{W}", "\u3000a\x85b  c ", "größe 2016/9/27:20:30:31 ж"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(spaced_words(F.col("t")).alias("s"))
    got = [tuple(r) for r in df.select("s", n_words(df["s"]), n_literal_wildcards(df["s"])).collect()]
    assert got == [("", 0, 0), ("a", 1, 0), (f"{W} b {W} x{W}", 4, 2), ("a b c", 3, 0), (f"größe {W} ж", 3, 1)]
