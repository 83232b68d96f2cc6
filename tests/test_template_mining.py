"""Similarity mining against a small sequential model of the rule."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.components import connected_components
from logloom.operators.mining_checks import first_fit_violations
from logloom.operators.templates import (
    _last_lines,
    MinedTemplates,
    attach_templates,
    distinct_templates,
    drain_templates,
    mine_templates,
    template_catalogue,
    template_versions,
)
from logloom.sources.detect import read_numbered

W = "<*>"


def model(messages, threshold):
    """First fit in order, on whole lists: the rule itself, nothing shared with the engine."""
    by_length, out, n = {}, [], 0
    for message in messages:
        tokens = message.split()
        if not tokens:
            out.append((0, ""))
            continue
        for cluster in by_length.setdefault(len(tokens), []):
            merged = [a if a == b else W for a, b in zip(cluster["t"], tokens)]
            if 1.0 - merged.count(W) / len(merged) >= threshold:
                cluster["t"] = merged
                break
        else:
            n += 1
            cluster = {"id": n, "t": tokens}
            by_length[len(tokens)].append(cluster)
        out.append((cluster["id"], " ".join(cluster["t"])))
    return out


def messages(seed, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        length = rng.choice([0, 1, 2, 3, 4, 4, 5, 8, 8, 8, 9])
        words = ["abc"[rng.randrange(3)] + str(i % 3) for i in range(length)]
        for i in range(length):
            if rng.random() < 0.25:
                words[i] = rng.choice(["x", "y", "z", W])
        out.append(" ".join(words))
    return out


def frame(spark, texts, parts=4):
    rows = list(enumerate(texts, 1))
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "line bigint, message_raw string").repartition(parts)


def run(spark, texts, threshold, **options):
    df = frame(spark, texts)
    mined = mine_templates(df, threshold, **options)
    rows = attach_templates(df, mined).orderBy("line").collect()
    return [(r["event_id"], r["template"]) for r in rows], mined


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_one_round_matches_model(spark, seed, threshold):
    texts = messages(seed)
    got, mined = run(spark, texts, threshold)
    assert got == model(texts, threshold)
    assert mined.rounds == 1


@pytest.mark.parametrize("seed", range(2))
def test_many_rounds_and_component_blocks_match_model(spark, seed):
    texts = messages(100 + seed, 250)
    got, mined = run(spark, texts, 0.75, batch=16, split_after=1, masks=2)
    assert got == model(texts, 0.75)
    assert mined.rounds > 2


def test_low_threshold_rounds(spark):
    texts = messages(5, 200)
    got, mined = run(spark, texts, 0.5, batch=30)
    assert got == model(texts, 0.5)


def test_two_hundred_seeds_in_many_rounds(spark):
    """Logs of 200 seeds, with words of their own, in one run; each must come out as its model says."""
    logs = {seed: [" ".join(w if w == W else f"{w}_{seed}" for w in t.split()) for t in messages(seed, 60)] for seed in range(200)}
    order = sorted((i, seed) for seed, log in logs.items() for i in range(len(log)))
    got, mined = run(spark, [logs[seed][i] for i, seed in order], 0.75, batch=300, masks=3, split_after=3)
    assert mined.rounds > 2
    homes = {}
    for seed, log in logs.items():
        for i, (event, template) in enumerate(model(log, 0.75)):
            homes[i, seed] = (event, template)
    founders = {}
    for line, ((i, seed), (event, _)) in enumerate(zip(order, got), 1):
        want, _ = homes[i, seed]
        assert (want == 0) == (event == 0)
        if want:
            assert founders.setdefault((seed, want), event) == event
    assert [homes[i, seed][1] for i, seed in order] == [t for _, t in got]
    ids = list(founders.values())
    assert sorted(ids) == list(range(1, len(ids) + 1)) and ids == sorted(ids)


def violations(spark, texts, **options):
    df = frame(spark, texts)
    return first_fit_violations(df, mine_templates(df, **options)).first().asDict()


def test_replay_of_the_rule_finds_nothing(spark):
    texts = messages(300, 200)
    assert violations(spark, texts, batch=16, masks=1) == {"not_first_fit": 0, "merge_missed": 0, "unassigned": 0}


def mined_by_hand(spark, rows, versions):
    assignments = spark.createDataFrame([(t.split(), e) for t, e in rows], "tokens array<string>, event_id bigint")
    return MinedTemplates(assignments, spark.createDataFrame(versions, "event_id bigint, valid_from bigint, template string"), None, 0.75, 1)


def test_replay_of_the_rule_sees_wrong_mining(spark):
    texts = ["a b c d", "a b c e", "a b c f", "x y z w"]
    df = frame(spark, texts)
    never = mined_by_hand(spark, [(t, i) for i, t in enumerate(texts, 1)], [(i, i, t) for i, t in enumerate(texts, 1)])
    assert first_fit_violations(df, never).first().asDict() == {"not_first_fit": 2, "merge_missed": 0, "unassigned": 0}
    rows = [(texts[0], 1), (texts[1], 1), (texts[2], 1), (texts[3], 2)]
    right = [(1, 1, "a b c d"), (1, 2, f"a b c {W}"), (2, 4, "x y z w")]
    assert first_fit_violations(df, mined_by_hand(spark, rows, right)).first().asDict() == {"not_first_fit": 0, "merge_missed": 0, "unassigned": 0}
    kept = [(1, 1, "a b c d"), (2, 4, "x y z w")]
    assert first_fit_violations(df, mined_by_hand(spark, rows, kept)).first()["merge_missed"] == 2
    late = [(1, 1, "a b c d"), (1, 3, f"a b c {W}"), (2, 4, "x y z w")]
    assert first_fit_violations(df, mined_by_hand(spark, rows, late)).first()["merge_missed"] == 1
    wrong = [(texts[0], 1), (texts[1], 1), (texts[2], 1), (texts[3], 1)]
    assert first_fit_violations(df, mined_by_hand(spark, wrong, right[:2])).first()["merge_missed"] == 1
    assert first_fit_violations(df, mined_by_hand(spark, rows[:3], right)).first()["unassigned"] == 1


def test_frequent_messages_stay_where_they_are(spark):
    texts = ["hot message of all days"] * 60 + [f"rare {i} of many kinds {i}" for i in range(120)] + ["hot message of all nights"] * 20
    df = frame(spark, texts)
    mined = mine_templates(df)
    plain = attach_templates(df, mined, frequent_share=1.0)
    hot = attach_templates(df, mined, frequent_share=0.05)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = attach_templates(df, mined, frequent_share=0.05)._jdf.queryExecution().optimizedPlan().toString()
        physical = attach_templates(df, mined, frequent_share=0.05)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "rightHint=(strategy=broadcast)" in plan
    # The branch of the frequent messages only meets broadcast tables; the other keeps none of their rows.
    first, rest = physical.split("SortMergeJoin", 1)
    assert "BroadcastHashJoin" in first or "BroadcastHashJoin" in rest
    assert "LeftAnti" in physical


def test_own_line_numbers_need_no_check(spark, tmp_path):
    (tmp_path / "a.log").write_text("Jun 14 15:16:01 combo sshd[1]: hi there you all\n" * 3)
    (tmp_path / "b.csv").write_text("lineid,content\n1,a\n1,b\n")
    entries, unique = read_numbered(spark, str(tmp_path / "a.log"), 2024)
    assert unique and mine_templates(entries, lines_are_unique=unique).assignments.first()["rows"] == 3
    entries, unique = read_numbered(spark, str(tmp_path / "b.csv"))
    assert not unique
    with pytest.raises(ValueError, match="lines repeat"):
        mine_templates(entries, lines_are_unique=unique)


def test_versions_and_catalogue(spark):
    texts = ["a b c d", "a b c e", "a b c f", "", "q r", "q r", f"{W} {W} c d", f"{W} {W} c d"]
    df = frame(spark, texts)
    mined = mine_templates(df)
    entries = attach_templates(df, mined).persist()
    versions = [tuple(r) for r in template_versions(mined).orderBy("event_id", "version").collect()]
    assert versions == [
        (1, 1, 1, 2, "a b c d"),
        (1, 2, 2, None, f"a b c {W}"),
        (2, 1, 5, None, "q r"),
    ]
    cat = {r["event_id"]: (r["template"], r["count"], r["first_line"]) for r in template_catalogue(entries).collect()}
    lone = f"{W} {W} c d"
    assert cat == {1: (f"a b c {W}", 3, 1), 2: ("q r", 2, 5), 3: (lone, 1, 7), 4: (lone, 1, 8)}
    found = [tuple(r) for r in distinct_templates(entries).orderBy("template_idx").collect()]
    assert [f[:3] for f in found] == [(0, 1, "a b c d"), (1, 1, f"a b c {W}"), (2, 2, "q r"), (3, 3, lone), (4, 4, lone)]
    assert distinct_templates(entries, per="event").count() == 4


def test_embedded_stamp_is_one_wildcard(spark):
    texts = ["at 2016/9/27:20:30:31 now ok fine", "at 2016/9/28:20:30:32 now ok fine"]
    rows = drain_templates(frame(spark, texts)).orderBy("line").collect()
    assert {r["event_id"] for r in rows} == {1}
    assert rows[1]["template"] == f"at {W} now ok fine"


def test_empty_input(spark):
    df = frame(spark, []).select("line", "message_raw")
    assert drain_templates(df).count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == want


def test_repeated_lines_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i"), (1, "a b c d e f g h i j k l")], "line bigint, message_raw string")
    with pytest.raises(ValueError, match="lines repeat"):
        mine_templates(rows)


@pytest.mark.parametrize("deal", [40, 1000])
def test_a_batch_is_cut_without_sorting_a_block_in_one_task(spark, deal):
    rows = [(5, 0, 7 * i % 5003) for i in range(900)] + [(6, 1, 10_000 + i) for i in range(20)]
    left = spark.createDataFrame(rows, "n_tok int, block bigint, first_line bigint")
    last = {(r["n_tok"], r["block"]): r["last"] for r in _last_lines(left, ["n_tok", "block"], 900, 60, deal).collect()}
    ordered = sorted(r[2] for r in rows if r[0] == 5)
    assert last == {(5, 0): ordered[59], (6, 1): 10_019}


def test_skewed_deals_give_a_shorter_batch_without_gaps(spark):
    # All lines that the hash deals to one of nine.
    found = spark.range(20_000).filter("pmod(xxhash64(id), 9) = 3").limit(900)
    left = found.selectExpr("5 n_tok", "0L block", "id first_line")
    last = _last_lines(left, ["n_tok", "block"], 900, 300, 100).first()["last"]
    ordered = sorted(r["first_line"] for r in left.collect())
    assert last in ordered[:300] and ordered.index(last) >= 60
