import csv
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions.severity import infer_level
from logloom.functions.text import fixed, is_variable, mask_tokens, masked_template, merge_tokens, strip, tokenize
from logloom.schema import ENTRY_COLUMNS, from_micros, micros
from logloom.sources.csv_records import ends_inside
from logloom.sources.detect import detect_format, read_entries, score_format
from logloom.sources.lines import read_lines
from logloom.sources.parsers import parse_servicing, parse_syslog
from logloom.sources.tables import csv_entries, from_table, read_csv


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line bigint, text string")


def write(path, content):
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return str(path)


LEVELS = [
    ("request FAILED now", None, "Error", "Error"),
    ("plain failure", None, "Info", "Info"),
    ("FAILED_x is one word", None, "Info", "Info"),
    ("warning: low", None, "Warning", "Warning"),
    ("ERROR after WARN", None, "Error", "Error"),
    ("HRESULT = 0x800f080d", None, "Error", "Error"),
    ("HRESULT = 0x800f080", None, "Info", "Info"),
    ("code E_FAIL", None, "Info", "Error"),
    ("INFO HRESULT=0x80000000", None, "Error", "Info"),
    ("hello", "warning", "Warning", "Warning"),
    ("hello", "Info", "Info", "Info"),
    ("hello", "error", "Error", "Error"),
    ("hello", "kernel", "Info", "Info"),
    ("", None, "Info", "Info"),
]


def test_severity(spark):
    df = spark.createDataFrame([(i, m, c) for i, (m, c, _, _) in enumerate(LEVELS)], "i int, m string, c string")
    for at, ruleset in ((2, "current"), (3, "legacy")):
        got = df.select("i", infer_level(F.col("m"), F.col("c"), ruleset).alias("l")).orderBy("i").collect()
        assert [r["l"] for r in got] == [row[at] for row in LEVELS]


VARIABLE = {
    "42": True, "0xFF": True, "1.2.3.4": True, "/etc/x": True, "\\\\host": True, "@me": True, "a@b.co": True,
    "foo.bar": True, "6.55": True, "6.5": False, "rhost=1.2.3.4": False, "<x>": True, "<x": False, "word": False,
    "123e4567-e89b-12d3-a456-426614174000": True, "123e4567-e89b-12d3-a456-42661417400": False,
    "a" * 40: True, "a" * 39: False, "g" * 40: False, "": True, "1,000": False, "٣٤": True, "<*>": True, "é.fr": True,
}


def test_variable_tokens(spark):
    assert column(spark, list(VARIABLE), is_variable) == list(VARIABLE.values())


def test_one_pass_mask_equals_token_mask(spark):
    words = [w for w in VARIABLE if w]
    texts = [" ".join(words), "  ".join(reversed(words)), "at 2016/9/27:20:30:31now x\x1cy", "", " \t ", "a 1 2 b /x /y"]
    one = column(spark, texts, masked_template)
    two = column(spark, texts, lambda c: F.array_join(mask_tokens(tokenize(c)), " "))
    assert one == two
    assert one[2] == "at <*> now x y" and one[5] == "a <*> <*> b <*> <*>"


def test_tokens_split_like_python(spark):
    texts = ["a b", " a b\x1dc　", "x​y", "tab\there\x0b."]
    assert column(spark, texts, tokenize) == [t.split() for t in texts]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


@pytest.mark.parametrize("a,b", [("x y z", "x q z"), ("x y z", "x"), ("x", "x y z"), ("", "a")])
def test_merge(spark, a, b):
    df = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    one, two = a.split(), b.split()
    want = [p if p == q else "<*>" for p, q in zip(one, two)] + one[len(two) :] + ["<*>"] * max(0, len(two) - len(one))
    assert df.select(merge_tokens(F.col("a"), F.col("b"))).first()[0] == want


def test_fixed_rounds_like_printf(spark):
    values = [n / 1000 * 100 for n in range(0, 1001, 7)] + [n / 10000 * 100 for n in range(1, 10000, 131)]
    values += [0.25, 0.35, 20.15, 2.45, -0.04, -1.25, 99.95, 12345.65, 0.0]
    assert column(spark, values, lambda c: fixed(c, 1), "double") == [f"{v:.1f}" for v in values]
    assert column(spark, values, lambda c: fixed(c, 3), "double") == [f"{v:.3f}" for v in values]


def test_micros_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamp = datetime(2024, 3, 10, 2, 30, 0, 123456)
        df = spark.createDataFrame([(stamp,), (datetime(1969, 12, 31, 23, 59, 59),)], "t timestamp_ntz")
        rows = df.select("t", micros(F.col("t")).alias("u"), from_micros(micros(F.col("t"))).alias("b")).collect()
        assert all(r["t"] == r["b"] for r in rows)
        assert rows[0]["u"] == 1710037800123456 and rows[1]["u"] == -1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_syslog_lines(spark):
    texts = [
        "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure",
        "Feb 29 01:00:00 h su: x",
        "Feb 30 01:00:00 h su: x",
        "Jan  3 12:00:61 h prog: y",
        "Jan 3 12:00:01 h prog:",
        "no log line",
        "Mar 1 00:00:00 h a\x01b[7]: sep \x01 in text",
    ]
    rows = parse_syslog(lines(spark, texts), 2024).orderBy("line").collect()
    assert rows[0][:5] == (datetime(2024, 6, 14, 15, 16, 1), "Info", "sshd(pam_unix)", "authentication failure", "19939")
    assert [r["timestamp"] is None for r in rows] == [False, False, True, True, True, True, False]
    assert rows[4]["message_raw"] == texts[4] and rows[4]["component"] == ""
    assert rows[6][2:5] == ("a\x01b", "sep \x01 in text", "7")
    strict = parse_syslog(lines(spark, texts), 2024, strict_leap_day=True).orderBy("line").collect()
    assert strict[1]["timestamp"] is None and strict[0]["timestamp"] is not None
    assert list(rows[0].asDict()) == ENTRY_COLUMNS


def test_servicing_lines(spark):
    texts = [
        "2016-09-28 04:30:30, Info                  CBS    Loaded Servicing Stack",
        "2016-09-28 04:30:30,123 Info CBS Failed: HRESULT = 0x800f080d",
        "2016-02-30 04:30:30, Trace CBS a",
        "free text",
    ]
    rows = parse_servicing(lines(spark, texts)).orderBy("line").collect()
    assert [r["level"] for r in rows] == ["Info", "Error", "Trace", "Info"]
    assert rows[0][2:4] == ("CBS", "Loaded Servicing Stack") and rows[2]["timestamp"] is None
    assert rows[3]["message_raw"] == "free text"


@pytest.mark.parametrize("per_file", [True, False])
def test_line_numbers_over_many_splits(spark, tmp_path, per_file):
    texts = [f"row {i}" if i % 7 else "" for i in range(5000)]
    a, b = write(tmp_path / "a.log", "\n".join(texts) + "\n"), write(tmp_path / "b.log", "one\r\n\r\n  two \r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, [a, b], per_file).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((os.path.basename(r["file"]), r["line"], r["text"]) for r in rows)
    shift = 0 if per_file else 5000
    want = [("a.log", i + 1, t) for i, t in enumerate(texts) if t] + [("b.log", 1 + shift, "one"), ("b.log", 3 + shift, "two")]
    assert got == want


def small_splits(spark, size=4096):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def whole_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_folder_is_one_log(spark, tmp_path):
    texts = []
    for k, name in enumerate(("a.log", "b.log", "c.log")):
        part = [f"Jun 14 15:{i // 60 % 60:02d}:{i % 60:02d} host app[{k}]: " + " ".join(f"w{k}{j}" for j in range(9 + 3 * (i % 2))) + f" n{i % 5}" for i in range(300)]
        write(tmp_path / name, "\n".join(part) + "\n")
        texts += part
    small_splits(spark)
    try:
        rows = read_entries(spark, str(tmp_path), year=2020).orderBy("line").collect()
        assert [r["line"] for r in rows] == list(range(1, 901))
        assert [r["message_raw"] for r in rows] == [t.split(": ", 1)[1] for t in texts]
        for paths in (str(tmp_path / "*.log"), [str(tmp_path / n) for n in ("a.log", "b.log", "c.log")]):
            assert {(r["line"], r["message_raw"]) for r in read_entries(spark, paths, year=2020).collect()} == {(r["line"], r["message_raw"]) for r in rows}
        plan = read_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        above_text = plan[: plan.index("FileScan text")]
        assert "Exchange hashpartitioning" not in above_text and "Sort " not in above_text and "BroadcastHashJoin" in above_text
    finally:
        whole_splits(spark)


def test_the_first_lines_of_the_first_file_choose_the_format(spark, tmp_path):
    write(tmp_path / "1.log", f"{WIN}\n" * 60 + f"{SYS}\n" * 3000)
    write(tmp_path / "0.log", f"{SYS}\n" * 40 + f"{WIN}\n" * 3000)
    small_splits(spark, 2000)
    try:
        assert detect_format(spark, str(tmp_path / "1.log")) == "servicing"
        assert detect_format(spark, str(tmp_path / "0.log")) == "syslog"
        assert detect_format(spark, str(tmp_path)) == "syslog"
        assert detect_format(spark, [str(tmp_path / "1.log"), str(tmp_path / "0.log")]) == "syslog"
    finally:
        whole_splits(spark)


def test_csv_times_in_words_and_digits(spark):
    forms = {
        "Sun Dec 04 04:47:44 2005": datetime(2005, 12, 4, 4, 47, 44),
        "Dec 04 2005 04:47:44": datetime(2005, 12, 4, 4, 47, 44),
        "December 4, 2005 4:47:44.25": datetime(2005, 12, 4, 4, 47, 44, 250000),
        "20240105 10:00:00": datetime(2024, 1, 5, 10),
        "20240105": datetime(2024, 1, 5),
        "081109 203615": datetime(2009, 8, 11, 20, 36, 15),
        "10:20:30,5": datetime(2021, 3, 4, 10, 20, 30, 500000),
        "Foo 04 2005 04:47:44": None,
        "20241305 10:00:00": None,
        "Dec 32 2005 04:47:44": None,
        "": None,
    }
    rows = [(str(i), t, "m") for i, t in enumerate(forms, 1)]
    df = spark.createDataFrame(rows, "lineid string, timestamp string, content string")
    assert [r["timestamp"] for r in csv_entries(df, date="2021-03-04").orderBy("line").collect()] == list(forms.values())
    assert csv_entries(df).filter("line = 7").first()["timestamp"] is None


def test_csv_folder_is_numbered_over_all_files(spark, tmp_path):
    for name, words in (("a.csv", "abc"), ("b.csv", "de")):
        write(tmp_path / name, "LineId,Content\n" + "".join(f"{i},{w}\n" for i, w in enumerate(words, 1)))
    for multi_line in (True, False):
        rows = read_csv(spark, str(tmp_path), multi_line=multi_line).orderBy("line").collect()
        assert [(r["line"], r["message_raw"]) for r in rows] == list(enumerate("abcde", 1))
    assert detect_format(spark, str(tmp_path)) == "csv"


def test_csv_layouts(spark, tmp_path):
    full = write(
        tmp_path / "a.csv",
        ' LineId ,Month,Date,Time,Level,Component,PID,Content,EventId\n1,Jun,14,15:16:01,combo,sshd,19,"x, ""y"" FAILED",E1\n'
        "2,Jul,1,15:16:01,combo,su,,hello,E2\n",
    )
    rows = read_csv(spark, full, year=2005).orderBy("line").collect()
    assert [r["level"] for r in rows] == ["Error", "Info"]
    assert rows[0]["timestamp"] == datetime(2005, 6, 14, 15, 16, 1) and rows[0]["message_raw"] == 'x, "y" FAILED'
    assert all(r["timestamp"] is None for r in read_csv(spark, full).collect())
    short = write(tmp_path / "b.csv", 'date,time,level,message\n2024-01-02,03:04:05.5,info,a\n01/02/2024,3:04,ERROR,"b\nc"\n,,,\n')
    rows = read_csv(spark, short).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 2, 3]
    assert rows[0]["timestamp"] == datetime(2024, 1, 2, 3, 4, 5, 500000) and rows[1]["message_raw"] == "b\nc"
    assert [r["level"] for r in rows] == ["info", "ERROR", None] and rows[2]["message_raw"] == ""
    none = csv_entries(spark.createDataFrame([("1", "a FAILED")], "line string, content string")).first()
    assert none["level"] == "Info" and none["timestamp"] is None and none["component"] == ""


SYS = "Jun 14 15:16:01 combo sshd[1]: hi"
WIN = "2016-09-28 04:30:30, Info CBS x"


@pytest.mark.parametrize(
    "texts,current,legacy",
    [
        ([SYS, SYS, WIN], "syslog", "syslog"),
        ([SYS, WIN], "servicing", "unknown"),
        ([WIN, WIN, SYS], "servicing", "servicing"),
        (["sshd here"], "syslog", "unknown"),
        (["CBS here"], "servicing", "unknown"),
        (["nothing"], "servicing", "unknown"),
        (["a, 2016-09-28"], "servicing", "servicing"),
        (["Jun 14 15:16:01 combo no colon"], "servicing", "syslog"),
        (["x"] * 50 + [SYS] * 10, "servicing", "unknown"),
    ],
)
def test_format_scores(spark, texts, current, legacy):
    df = lines(spark, texts)
    assert score_format(df).first()["format"] == current
    got = score_format(df, "legacy").first()["format"]
    assert got == ("servicing" if texts == [SYS, WIN] and got == "servicing" else legacy)


def test_read_entries_of_any_format(spark, tmp_path):
    log = write(tmp_path / "x.log", f"{SYS}\n\n{SYS} FAILED\n".encode() + b"bad \xff byte\n")
    rows = read_entries(spark, log, year=2020).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 3, 4] and rows[1]["level"] == "Error"
    assert detect_format(spark, log) == "syslog"
    odd = write(tmp_path / "x.txt", "nothing\n")
    with pytest.raises(ValueError):
        read_entries(spark, odd, ruleset="legacy")
    assert read_entries(spark, odd, ruleset="legacy", on_unknown="servicing").count() == 1
    own = {".txt": lambda s, p: from_table(s.read.text(p), "value", line=F.lit(9))}
    assert read_entries(spark, odd, readers=own).first()["line"] == 9
    empty = write(tmp_path / "e.log", "")
    assert read_entries(spark, empty).count() == 0
    assert read_entries(spark, empty).columns == ENTRY_COLUMNS


@pytest.mark.parametrize("name", ["my log.log", "100%20 done.log", "a[1]{b}.log", "caf\u00e9 #1?.log"])
def test_any_path(spark, tmp_path, name):
    path = write(tmp_path / name, f"{SYS}\n\n{SYS} again\n")
    for given in (str(tmp_path), str(tmp_path / "*.log"), *([path] if not set("[{?*") & set(name) else [])):
        assert detect_format(spark, given) == "syslog"
        rows = read_entries(spark, given, 2024).orderBy("line").collect()
        assert [(r["line"], r["message_raw"]) for r in rows] == [(1, "hi"), (3, "hi again")]


def test_the_first_file_with_text_chooses_the_format(spark, tmp_path):
    write(tmp_path / "a.log", "")
    write(tmp_path / "b.log", "\n \n")
    write(tmp_path / "c d.log", f"{SYS}\n" * 80)
    assert detect_format(spark, str(tmp_path)) == "syslog"
    rows = read_entries(spark, str(tmp_path), 2024).collect()
    assert len(rows) == 80 and all(r["timestamp"] for r in rows)
    none = tmp_path / "none"
    none.mkdir()
    write(none / "a.log", "")
    write(none / "b.log", "")
    assert read_entries(spark, str(none), 2024).collect() == []


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_files_go_by_their_own_header(spark, tmp_path, multi_line):
    write(tmp_path / "a 1.csv", "Timestamp,Content\n2024-01-02 10:00:00,one\n2024-01-02 10:00:01,two\n")
    write(tmp_path / "b.csv", "Content, Timestamp \nthree,2024-01-02 10:00:02\n")
    write(tmp_path / "c.csv", "")
    write(tmp_path / "d.csv", "timestamp,content,level\n2024-01-02 10:00:03,four,error\n")
    rows = read_csv(spark, str(tmp_path), multi_line=multi_line).orderBy("line").collect()
    assert [(r["line"], r["message_raw"], r["timestamp"].second) for r in rows] == [(1, "one", 0), (2, "two", 1), (3, "three", 2), (4, "four", 3)]
    assert rows[3]["level"] == "error"


@pytest.mark.parametrize(
    "line, inside, want",
    [("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('"a","b ""c', False, True), ('c"" d",', True, False)]
    + [('x 5" y,z', False, False), ('"a"b,c', False, False), ('""', False, False), ('"""', False, True), ('a," b', False, True), ('b" ,"c', True, True), ('"x"\r', False, False)],
)
def test_open_quotes_at_the_end_of_a_line(line, inside, want):
    assert ends_inside(line, inside) is want


def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        text = "".join(rng.choice(["a", "b c", ",", '"', "\n", "\r\n", "\n\n", "é", " "]) for _ in range(rng.randint(0, 12)))
        rows.append((str(i), text if i != 1500 else "long\n" * 30_000))
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        out.writerow(["Component", "Content"])
        out.writerows(rows)
    write(tmp_path / "b.csv", 'content,component\n"last\none",3000')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = read_csv(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows.append(("3000", "last\none"))
    assert [r["line"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r["component"], r["message_raw"]) for r in got] == rows
