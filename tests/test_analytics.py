import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.operators import bursts as B
from logloom.operators import clustering as C
from logloom.operators import semantics as E
from logloom.operators import similarity as SIM
from logloom.operators import stats as S
from logloom.operators import timeseries as W
from logloom.operators.numbering import dense_number
from logloom.plans.analyze import analyze, write_entries
from logloom.plans.reports import kpis, markdown_report, short_type, text_report, write_markdown

SCHEMA = (
    "timestamp timestamp_ntz, level string, component string, message_raw string, pid string, source string, line bigint,"
    " event_id bigint, template string"
)
T0 = datetime(2024, 1, 1)


def entries(spark, rows):
    """Rows of (seconds or None, event id, level)."""
    data = [
        (None if s is None else T0 + timedelta(seconds=s), level, f"c{e}", f"m{e} {i % 3}", "", "t", i, e, f"t{e} v{i // 50}")
        for i, (s, e, level) in enumerate(rows, 1)
    ]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def some_log(seed, n=400, span=20_000):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(span), rng.choice([1, 1, 1, 2, 3]), rng.choice(["Info", "Error", "Warning"])) for _ in range(n))
    return [r if i % 10 else (None, *r[1:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seconds,repeats,own", [(10, 2, False), (60, 3, False), (600, 5, True)])
def test_bursts_against_brute_force(spark, seconds, repeats, own):
    rows = some_log(1, 300, 3000) + [(1500, 1, "Info")] * 40
    timed = [(s, e) for s, e, _ in rows if s is not None]
    want = {}
    for t in {s for s, _ in timed}:
        seen = Counter(e for s, e in timed if t - seconds <= s <= t)
        for e, n in seen.items():
            if n >= repeats and (not own or (t, e) in timed):
                want[(t, e)] = n
    got = B.repetition_bursts(entries(spark, rows), repeats, seconds, own_event_only=own).collect()
    assert {(int((r["timestamp"] - T0).total_seconds()), r["event_id"]): r["count_in_window"] for r in got} == want
    assert len(got) == len(want)
    last = {e: f"t{e} v{i // 50}" for i, (_, e, _) in enumerate(rows, 1)}
    assert all(r["template"] == last[r["event_id"]] for r in got)


def test_stats_and_summary(spark):
    rows = some_log(2)
    df = entries(spark, rows)
    got = {r["event_id"]: r for r in S.template_stats(df).collect()}
    for e, r in got.items():
        mine = [(i, s) for i, (s, x, _) in enumerate(rows, 1) if x == e]
        times = [s for _, s in mine if s is not None]
        assert r["count"] == len(mine) and r["template"] == f"t{e} v{mine[0][0] // 50}"
        assert r["duration_seconds"] == max(times) - min(times) and r["components"] == f"c{e}"
        assert r["rate_per_hour"] == pytest.approx(len(mine) / (r["duration_seconds"] / 3600 + 1))
        assert r["unique_messages"] == len({i % 3 for i, _ in mine})
    assert sum(r["frequency_pct"] for r in got.values()) == pytest.approx(100)
    assert S.template_stats(df, approx=True).count() == 3
    one = S.pattern_summary(df, S.template_stats(df)).first()
    assert one["total_lines"] == 400 and one["unique_events"] == 3 and one["top_event_count"] == got[1]["count"]
    assert one["top10_coverage"] == pytest.approx(100) and one["rare_events_count"] == 0
    levels = S.level_distribution(df).collect()
    assert sum(r["count"] for r in levels) == 400 and sum(r["percentage"] for r in levels) == pytest.approx(100)
    modal = spark.createDataFrame([(1, "b", "x", "m", None, 1), (1, "a", "x", "m", None, 2), (1, None, "x", "m", None, 3)],
        "event_id int, component string, template string, message_raw string, timestamp timestamp_ntz, line int")
    row = S.template_stats(modal).first()
    assert row["components"] == "a" and row["duration_seconds"] == 0 and row["rate_per_hour"] == 3


def test_no_timestamps_and_no_rows(spark):
    untimed = entries(spark, [(None, 1, "Info"), (None, 2, "Error")])
    none = untimed.limit(0)
    for df in (untimed, none):
        assert W.anomaly_windows(df).count() == 0
        assert W.time_series(df).count() == 0
        assert W.volume_bursts(df).count() == 0
        assert B.repetition_bursts(df, 1).count() == 0
        assert S.hour_distribution(df).count() == 0
    features = W.temporal_features(untimed).select("hour", "day_of_week", "window_id").distinct().collect()
    assert [tuple(r) for r in features] == [(0, 0, 0)]
    assert S.hour_distribution(untimed, include_untimed=True).first()["count"] == 2
    assert S.pattern_summary(none, S.template_stats(none)).first()["total_lines"] == 0


def test_series_and_anomalies_against_brute_force(spark):
    rows = some_log(4, 400, 60 * 300) + [(9000 + i, 1, "Error") for i in range(60)]
    df = entries(spark, rows)
    bins = defaultdict(list)
    for s, e, level in rows:
        if s is not None:
            bins[s // 300].append((e, level))
    grid = range(min(bins), max(bins) + 1)
    count = [len(bins[b]) for b in grid]
    unique = [len({e for e, _ in bins[b]}) for b in grid]
    got = W.time_series(df).orderBy("timestamp").collect()
    assert [r["total"] for r in got] == count and [r["unique_templates"] for r in got] == unique
    assert [r["error_count"] for r in got] == [sum(v == "Error" for _, v in bins[b]) for b in grid]
    width = W.adaptive_width(len(count))
    assert width == 10

    def z(values, i):
        window = values[max(0, i - width + 1) : i + 1]
        std = statistics.stdev(window) if len(window) > 1 else 0.0
        return (values[i] - statistics.mean(window)) / (std + 1e-8)

    mean, std = statistics.mean(count), statistics.stdev(count)
    want = {}
    for th in (2.5, 1.5):
        want[th] = []
        for i, b in enumerate(grid):
            scores = (z(count, i), z(unique, i), (count[i] - mean) / (std + 1e-8))
            if abs(scores[0]) > th or abs(scores[1]) > th or abs(scores[2]) > 1.5 * th:
                names = [f"{n}_{'burst' if v > 0 else 'drop'}" for n, v in zip(("volume", "diversity", "global"), scores) if abs(v) > th]
                want[th].append((T0 + timedelta(seconds=300 * b), count[i], "+".join(names) or "unknown"))
        found = W.anomaly_windows(df, threshold=th).orderBy("timestamp").collect()
        assert [(r["timestamp"], r["count"], r["anomaly_type"]) for r in found] == want[th]
    assert want[1.5]
    top = found[0]["top_events"]
    assert 1 <= len(top) <= 3 and top[0]["count"] >= top[-1]["count"]
    assert ". Top: " in found[0]["interpretation"]
    assert "top_events" not in W.anomaly_windows(df, threshold=3, with_top=False).columns


@pytest.mark.parametrize("chunk", [7, 10, 64])
def test_rolling_in_chunks_equals_one_window(spark, chunk):
    rng = random.Random(5)
    series = spark.createDataFrame([(i - 20, rng.randrange(50)) for i in range(200)], "bin bigint, count bigint")
    one = W.rolling(series, ["count"], 7, chunk=10_000).orderBy("bin").collect()
    got = W.rolling(series, ["count"], 7, chunk=chunk).orderBy("bin").collect()
    assert [r["bin"] for r in got] == [r["bin"] for r in one]
    assert [r["count_std"] for r in got] == pytest.approx([r["count_std"] for r in one])


def test_width_and_short_series(spark):
    assert [W.adaptive_width(n) for n in (0, 4, 5, 15, 20, 45, 500)] == [None, None, 3, 3, 4, 9, 10]
    assert W.anomaly_windows(entries(spark, [(i * 300, 1, "Info") for i in range(4)])).count() == 0


def test_bins_that_do_not_divide_a_day_start_at_midnight(spark):
    got = W.time_series(entries(spark, [(3600, 1, "Info"), (90_000, 1, "Info")]), 7).orderBy("timestamp").collect()
    assert got[0]["timestamp"] == T0 + timedelta(minutes=56) and got[-1]["timestamp"] == T0 + timedelta(minutes=7 * 214)
    assert len(got) == 214 - 8 + 1


@pytest.mark.parametrize("step", [1, 1_000_000])
def test_dense_number_of_dense_and_sparse_keys(spark, step):
    keys = [k * step for k in sorted(random.Random(1).sample(range(-500, 5000), 300))]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = dense_number(df, "k", "n")
        assert {r["k"]: r["n"] for r in numbered.collect()} == {k: i for i, k in enumerate(keys, 1)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The offsets have a row per range of rows, however far the keys are apart.
    assert 1 < len(numbered.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_one_grid_for_bins_that_do_not_divide_a_day(spark):
    rows = [(60 * m, 1 + m % 2, "Info") for m in range(0, 2000, 3)] + [(60 * 700 + i % 60, 3, "Error") for i in range(300)]
    log = entries(spark, rows)
    starts = {r["timestamp"] for r in W.time_series(log, 7).collect()}
    found = W.anomaly_windows(log, 7).collect()
    bursts = W.volume_bursts(log, 7, threshold=2.0).collect()
    assert found and bursts and min(starts) == T0
    assert {r["timestamp"] for r in found} | {r["timestamp"] for r in bursts} <= starts
    peak = T0 + timedelta(minutes=700)
    by = {r["timestamp"]: r for r in found}
    assert peak in by and by[peak]["top_events"][0]["template"].startswith("t3")
    bins = sorted(r["bin"] for r in W.top_events(log, minutes=7).collect())
    assert bins == list(range(bins[0], bins[0] + len(starts)))


@pytest.mark.parametrize("finish_at", [2, 12, 2048])
def test_ties_give_one_tree_at_every_size(spark, finish_at):
    # Unit vectors along the axes and their opposites: nearly all distances are exactly 1 or 2.
    axes = [[float(s) if i == k else 0.0 for i in range(8)] for k in range(8) for s in (1, -1)]
    vectors = spark.createDataFrame(list(enumerate(axes)), "template_idx bigint, vector array<double>").repartition(3)
    tree = sorted(tuple(r) for r in C.average_linkage(vectors, block_rows=5, finish_at=finish_at).collect())
    clusters = [{"id": i, "sum": np.array(v), "n": 1} for i, v in enumerate(axes)]
    want = []
    while len(clusters) > 1:
        pairs = [
            (1 - a["sum"] @ b["sum"] / (a["n"] * b["n"]), a["id"], b["id"]) for i, a in enumerate(clusters) for b in clusters[i + 1 :]
        ]
        height, i, j = min(pairs)
        a, b = (next(c for c in clusters if c["id"] == x) for x in (i, j))
        a["sum"], a["n"] = a["sum"] + b["sum"], a["n"] + b["n"]
        clusters.remove(b)
        want.append((i, j, height, a["n"]))
    assert [t[:2] + t[3:] for t in tree] == [t[:2] + t[3:] for t in sorted(want)]
    assert np.allclose([t[2] for t in tree], [t[2] for t in sorted(want)])


def test_kmeans_says_when_it_was_cut_short(spark):
    vectors = frame(spark, cloud(3))
    with pytest.warns(UserWarning, match="k-means stopped after 1"):
        C.kmeans(vectors, 4, max_iterations=1)


# ---- vectors and clusters --------------------------------------------------------


def cloud(seed, n=60, dims=5, copies=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    x = centers[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, dims))
    x[:copies] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "template_idx bigint, vector array<double>")
    return df.withColumn("template", F.concat(F.lit("t"), "template_idx"))


def brute_dbscan(x, eps, least):
    near = (1 - x @ x.T) <= eps
    np.fill_diagonal(near, True)
    core, labels, label = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], todo = label, [i]
        while todo:
            for k in np.flatnonzero(near[todo.pop()]):
                if labels[k] < 0:
                    labels[k] = label
                    if core[k]:
                        todo.append(k)
        label += 1
    return labels.tolist()


@pytest.mark.parametrize("eps,least", [(0.05, 2), (0.02, 2), (0.06, 6)])
def test_dbscan_against_brute_force(spark, eps, least):
    x = cloud(int(eps * 100) + least)
    got = C.dbscan(frame(spark, x), eps, least, block_rows=13).orderBy("template_idx").collect()
    assert [r["cluster"] for r in got] == brute_dbscan(x, eps, least)


def brute_average_linkage(x, k):
    groups = [[i] for i in range(len(x))]
    apart = 1 - x @ x.T
    while len(groups) > k:
        best = min(
            ((apart[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        )
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("finish_at", [2048, 12])
def test_average_linkage_against_brute_force(spark, finish_at):
    x = cloud(3, 40)
    got = C.hierarchical(frame(spark, x), 5, block_rows=11, finish_at=finish_at).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["cluster"]].add(r["template_idx"])
    assert {frozenset(g) for g in groups.values()} == brute_average_linkage(x, 5)
    assert sorted(groups) == list(range(5))


def test_kmeans_points_are_nearest_to_their_own_center(spark):
    x = cloud(9)
    labels = {r["template_idx"]: r["cluster"] for r in C.kmeans(frame(spark, x), 4).collect()}
    groups = sorted(set(labels.values()))
    centers = np.stack([x[[i for i in labels if labels[i] == g]].mean(0) for g in groups])
    nearest = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert [groups[n] for n in nearest] == [labels[i] for i in range(len(x))]
    assert C.kmeans(frame(spark, x[:1])).count() == 0


def test_choose_k():
    assert [C.choose_k(n) for n in (2, 3, 10, 188, 199, 500, 69)] == [2, 2, 2, 9, 9, 15, 5]
    assert C.choose_k(10, 50) == 9 and C.choose_k(10, 1) == 2
    with pytest.raises(ValueError):
        C.choose_k(1)


def test_pairs_and_neighbours(spark):
    x = cloud(11, 50)
    df = frame(spark, x)
    sim = x @ x.T
    got = SIM.cosine_pairs(df, 0.1, block_rows=9).collect()
    distinct = [0, *range(8, 50)]
    want = {(i, j) for i in distinct for j in distinct if i < j and 1 - sim[i, j] <= 0.1}
    assert {(r["idx_a"], r["idx_b"]) for r in got} == want
    assert all(r["copies_a"] == (8 if r["idx_a"] == 0 else 1) for r in got)
    near = defaultdict(list)
    for r in SIM.nearest_vectors(df, 3, block_rows=9).orderBy("idx", "rank").collect():
        near[r["idx"]].append(r["other"])
    assert all(near[i] == sorted((j for j in distinct if j != i), key=lambda j: -sim[i, j])[:3] for i in distinct)


def test_near_cells_hold_each_near_pair_once_and_few_copies(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    x = np.repeat(centers, 50, 0) + 0.12 * rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    folded = frame(spark, x).select(F.col("template_idx").alias("idx"), "vector", F.lit(1).cast("bigint").alias("copies"))
    placed = SIM.place_near(folded, 2000, 0.1, ("copies",), block_rows=50)
    cells = defaultdict(lambda: ([], []))
    for r in placed.select("cell", "inner", "idx").collect():
        cells[r["cell"]][not r["inner"]].append(r["idx"])
    sim, met = x @ x.T, np.zeros((2000, 2000), int)
    for inner, outer in cells.values():
        met[np.ix_(inner, inner)] += 1
        met[np.ix_(inner, outer)] += 1
        met[np.ix_(outer, inner)] += 1
    assert (met[(1 - sim) <= 0.1] == 1).all()
    # A grid of blocks would copy each vector 40 times.
    assert sum(len(a) + len(b) for a, b in cells.values()) < 6 * 2000
    assert sorted(i for a, _ in cells.values() for i in a) == list(range(2000))


@pytest.mark.parametrize("distance", [0.05, 0.6, 1.2, 2.0])
def test_pairs_at_any_distance(spark, distance):
    x = cloud(21, 70)
    x[5] = 0
    x[6] = -x[20]
    got = {(r["idx_a"], r["idx_b"]): r["similarity"] for r in SIM.cosine_pairs(frame(spark, x), distance, block_rows=6).collect()}
    distinct = [0, *(i for i in range(1, 70) if not np.array_equal(x[i], x[0]))]
    assert got.keys() == {(i, j) for i in distinct for j in distinct if i < j and 1 - x[i] @ x[j] <= distance}
    assert SIM.cosine_pairs(frame(spark, x).limit(0), distance).collect() == []


def test_sparse_pairs_equal_the_dense_grid(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 9)))) for i in range(150)]
    texts = spark.createDataFrame([*rows, (900, rows[3][1]), (901, "")], "template_idx bigint, template string")
    weights = E.tfidf(texts, stop_words=[]).persist()
    dense = E.dense_from_sparse(weights, texts).filter("template <> ''")
    for distance in (0.2, 0.6, 0.9):
        # Equal weights come from equal counts; their dense copies are equal too.
        a, b = ({(r["idx_a"], r["idx_b"], r["copies_a"], r["copies_b"]): r["similarity"] for r in df.collect()} for df in (SIM.sparse_cosine_pairs(weights, distance), SIM.cosine_pairs(dense, distance)))
        assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(ValueError):
        SIM.sparse_cosine_pairs(weights, 1.0)


def test_average_linkage_compares_only_what_changed(spark):
    progress = []
    C.average_linkage(frame(spark, cloud(8, 120)), block_rows=30, finish_at=10, progress=progress).collect()
    assert len(progress) > 3 and progress[0]["compared"] == progress[0]["clusters"]
    assert sum(p["distances"] for p in progress) < 0.9 * sum(p["clusters"] ** 2 for p in progress)


def test_tfidf_and_outliers(spark):
    texts = ["disk error on node", "disk error on rack", "the of and", "login user", "disk disk login"]
    df = spark.createDataFrame(list(enumerate(texts)), "template_idx bigint, template string")
    weights = E.tfidf(df)
    by_text = defaultdict(dict)
    for r in weights.collect():
        by_text[r["template_idx"]][r["term"]] = r["weight"]
    assert 2 not in by_text and set(by_text[4]) == {"disk", "login"}
    assert all(sum(v * v for v in d.values()) == pytest.approx(1) for d in by_text.values())
    idf = lambda df: np.log(6 / (1 + df)) + 1
    assert by_text[4]["disk"] / by_text[4]["login"] == pytest.approx(2 * idf(3) / idf(2))
    sparse = {r["template_idx"]: r["distance"] for r in E.sparse_distances(weights, df).collect()}
    dense = {r["template_idx"]: r["distance"] for r in E.dense_distances(E.dense_from_sparse(weights, df)).collect()}
    assert sparse == pytest.approx(dense) and sparse[2] == 1
    found = {r["template_idx"]: r["severity"] for r in E.semantic_anomalies(E.sparse_distances(weights, df)).collect()}
    assert found[2] == "high"
    labelled = frame(spark, cloud(2, 20)).withColumn("label", F.when(F.col("template_idx") < 3, -1).otherwise(1))
    away = {r["template_idx"]: r["distance"] for r in E.label_distances(labelled).collect()}
    assert away[0] is None and away[19] is not None
    assert E.tfidf(df, max_terms=2).select("term").distinct().count() == 2


# ---- whole runs --------------------------------------------------------------------


def test_whole_run_and_reports(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=3 * i), ["Info", "Error"][i % 9 == 0], f"svc{i % 2}", f"user {i % 5} did {'open close'.split()[i % 2]} it now fine", "", "t", i + 1)
            for i in range(600)]
    df = spark.createDataFrame(rows, ", ".join(SCHEMA.split(",")[:7]))
    run = analyze(df, "unit", min_repeats=2)
    one = run.summary.first()
    assert one["total_lines"] == 600 and one["n_bursts"] == run.bursts.count()
    assert one["n_semantic_anomalies"] == run.semantic_anomalies.count()
    assert run.cluster_summaries.agg(F.sum("percentage")).first()[0] == pytest.approx(100)
    assert [r["metric"] for r in kpis(run.summary, dashboard=True).orderBy("ord").collect()][-1] == "Anomaly windows"
    write_markdown(markdown_report(run), str(tmp_path / "md"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "md")).collect())
    assert text.startswith("# Log Analysis Report — unit\n\n- **Total lines:** 600\n")
    for part in ("## Level Distribution\n\n| Level | Count | % |\n|---|---|---|\n| Info | 533 | 88.8% |", "## Top 10 Events", "repetition bursts (10s windows)"):
        assert part in text
    old = [r["line"] for r in markdown_report(run, "legacy").orderBy("section", "ord").collect()]
    assert "| Timestamp | Event ID | Repeats |" in old and "## Temporal Anomalies" in old
    running = [r["line"] for r in text_report(run).orderBy("section", "ord").collect()]
    assert running[2] == "**Total lines:** 600 | **Unique events:** 2 | **Errors:** 67 (11.2%) | **Warnings:** 0"
    assert "- **Info**: 533 (88.8%)" in running and "## Temporal Anomalies (Bursts)" in running
    write_entries(run.entries, str(tmp_path / "entries"))
    assert spark.read.parquet(str(tmp_path / "entries")).filter("day = date'2024-01-01'").count() == 600
    given = analyze(df, encoder=lambda t: t.withColumn("vector", F.array(F.lit(1.0), F.length("template").cast("double"))))
    assert given.summary.first()["unique_events"] == one["unique_events"]
    bare = analyze(df.limit(0), cluster=False)
    assert bare.summary.first()["total_lines"] == 0


def test_cluster_lists_are_in_index_order(spark):
    df = spark.createDataFrame([(3, "c", 0), (1, "a", 0), (2, "b", 1)], "template_idx int, template string, cluster int")
    rows = S.cluster_summary(df, with_templates=True).orderBy("cluster_id").collect()
    assert [(r["size"], r["sample"], r["templates"]) for r in rows] == [(2, "a", ["a", "c"]), (1, "b", ["b"])]


def test_short_type(spark):
    row = spark.range(1).select(short_type(F.lit("volume_burst+diversity_drop+global_burst")).alias("t")).first()
    assert row["t"] == "volume/diversity↓/gl"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans_stay_on_the_jvm_and_read_few_columns(spark, tmp_path):
    path = str(tmp_path / "e")
    entries(spark, some_log(6)).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (S.template_stats(df), W.binned_counts(df), W.temporal_features(df), W.top_events(df), B.repetition_bursts(df)):
        text = plan(out)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    text = plan(W.top_events(df))
    assert "ReadSchema: struct<timestamp:timestamp_ntz,line:bigint,event_id:bigint,template:string>" in text
    assert "IsNotNull(timestamp)" in text


def test_fine_stamps_cost_what_they_report(spark):
    """Many stamps and many events within one look-back: the stretches grow with the rows, the result with its pairs."""
    rng = random.Random(8)
    moments = [(e, 1_000_000 + 7 * i, 1) for i, e in enumerate(rng.choices(range(200), k=5000))] + [(999, 1_000_000 + 90 * i, 3) for i in range(20)]
    rows = spark.createDataFrame(moments, "event_id int, t bigint, n bigint")
    busy = B.busy_intervals(rows, 30, 1000).collect()
    assert busy and {r["event_id"] for r in busy} == {999} and len(busy) <= 3 * 20
    for r in busy:
        for at in (r["start"], r["end"] - 1):
            assert sum(n for e, t, n in moments if e == 999 and at - 1000 <= t <= at) == r["count"]


def test_one_event_with_a_third_of_the_rows(spark):
    """A hot event, second and message give the same results as their definition."""
    rows = sorted([(1000, 1, "Error")] * 500 + [(i * 3, 2 + i % 4, "Info") for i in range(1000)])
    df = entries(spark, rows)
    got = {(int((r["timestamp"] - T0).total_seconds()), r["event_id"]): r["count_in_window"] for r in B.repetition_bursts(df, 400).collect()}
    assert got == {(t, 1): 500 for t in {s for s, _, _ in rows} if 1000 <= t <= 1010}
    assert {r["event_id"]: r["count"] for r in S.template_stats(df).collect()}[1] == 500
    top = W.top_events(df).filter(F.col("bin") == W.bin_number(F.lit(T0 + timedelta(seconds=1000)).cast("timestamp_ntz"), 5)).first()
    assert top["top_events"][0]["count"] == 500


def test_cells_that_rule_nothing_out_make_no_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    folded = frame(spark, x).select(F.col("template_idx").alias("idx"), "vector", F.lit(1).cast("bigint").alias("copies"))
    assert SIM.place_near(folded, 600, 0.6, ("copies",), block_rows=8).count() == 600
    got = {(r["idx_a"], r["idx_b"]) for r in SIM.cosine_pairs(frame(spark, x), 0.6, block_rows=8).collect()}
    sim = x @ x.T
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if 1 - sim[i, j] <= 0.6}


@pytest.mark.parametrize("task_rows", [40, 150])
def test_sets_of_rows_in_tiles_give_the_same(spark, monkeypatch, task_rows):
    # Cells with copies, some sets a cell and some tiles a task, whose rows are folded on the way.
    monkeypatch.setattr(SIM, "ROW_COST", 0)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(6, 16)), 50, 0) + 0.35 * rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim, df = x @ x.T, frame(spark, x)
    folded = df.select(F.col("template_idx").alias("idx"), "vector", F.lit(1).cast("bigint").alias("copies"))
    assert SIM.place_near(folded, 300, 0.1, ("copies",), 20, task_rows).filter(~F.col("inner")).count()
    got = {(r["idx_a"], r["idx_b"]) for r in SIM.cosine_pairs(df, 0.1, block_rows=20, task_rows=task_rows).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if 1 - sim[i, j] <= 0.1}
    near = {}
    for r in SIM.nearest_vectors(df, 3, block_rows=20, task_rows=task_rows).collect():
        near[r["idx"], r["rank"]] = r["other"]
    np.fill_diagonal(sim, -2)
    assert near == {(i, k + 1): j for i in range(300) for k, j in enumerate(np.argsort(-sim[i], kind="stable")[:3])}
    labels = [C.dbscan(df, 0.1, 4, block_rows=b, task_rows=t).orderBy("template_idx").collect() for b, t in ((20, task_rows), (300, 300))]
    assert labels[0] == labels[1] and len({r["cluster"] for r in labels[0]}) > 2
    trees = [sorted((r["a"], r["b"], r["size"]) for r in C.average_linkage(df, b, 200, task_rows=t).collect()) for b, t in ((20, task_rows), (300, 300))]
    assert trees[0] == trees[1]


def test_links_of_tiles_fold_to_a_forest():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    found = pd.DataFrame({"u": np.r_[u, 900, 900], "v": np.r_[v, u[0], v[0]], "border": np.r_[np.zeros(300, bool), True, True]})
    found = found[found["u"] != found["v"]]
    root = np.arange(400)
    for _ in range(400):
        for a, b in zip(u, v):
            root[a] = root[b] = min(root[a], root[b])
    got = C._forest(found)
    trees = got[~got["border"]]
    assert sorted(zip(trees["u"], trees["v"])) == [(i, r) for i, r in enumerate(root) if i != r]
    assert got[got["border"]].values.tolist() == [[900, root[u[0]], True]]
    assert C._forest(got).values.tolist() == got.values.tolist()


def test_sparse_pairs_in_tiles_count_each_pair_once(spark, monkeypatch):
    # Few frequent terms: all lists are long, and most pairs share several of them.
    monkeypatch.setattr(SIM, "TILE", 64)
    monkeypatch.setattr(SIM, "TERMS", 2)
    rng = np.random.default_rng(6)
    x = rng.integers(1, 4, size=(90, 7)) * (rng.random((90, 7)) < 0.6).astype(float)
    x = np.unique(x[x.any(1)], axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"t{j}", float(w)) for i, r in enumerate(x) for j, w in enumerate(r) if w]
    weights = spark.createDataFrame(rows, "template_idx bigint, term string, weight double")
    sim = x @ x.T
    for distance in (0.05, 0.3, 0.8):
        got = [(r["idx_a"], r["idx_b"]) for r in SIM.sparse_cosine_pairs(weights, distance, block_rows=4, task_rows=16).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if 1 - sim[i, j] <= distance}


def test_lists_of_frequent_terms_are_one_cell(spark, monkeypatch):
    # Every vector has most of the twelve frequent terms, and every third one a rare term that a few others have.
    rng = np.random.default_rng(9)
    x = np.hstack([rng.integers(1, 4, size=(240, 12)) * (rng.random((240, 12)) < 0.8), np.zeros((240, 20))]).astype(float)
    x[::3, 12:] = 6.0 * np.eye(20)[rng.integers(0, 20, 80)]
    x = np.unique(x[x.any(1)], axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"t{j}", float(w)) for i, r in enumerate(x) for j, w in enumerate(r) if w]
    moved, keep = [], SIM.in_near_cells

    def counted(placed, *more):
        moved.append(placed.count())
        return keep(placed, *more)

    monkeypatch.setattr(SIM, "in_near_cells", counted)
    weights = spark.createDataFrame(rows, "template_idx bigint, term string, weight double")
    got = [(r["idx_a"], r["idx_b"]) for r in SIM.sparse_cosine_pairs(weights, 0.2917, block_rows=16, task_rows=100).collect()]
    sim = x @ x.T
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if 1 - sim[i, j] <= 0.2917}
    assert moved[0] < 2 * len(x)


def test_lists_of_rare_terms_stay_apart():
    rare = {"least": 0, "terms": 1_000_000, "rows": 2_000_000, "squares": 4e6, "last": 20_000}
    often = {"least": 7 << 33, "terms": 400, "rows": 4_000_000, "squares": 4e10, "last": 80_000}
    assert SIM._merged_from([rare, often], 8192) == 7 << 33
    assert SIM._merged_from([rare], 8192) is None
    assert SIM._merged_from([], 8192) is None


@pytest.mark.parametrize("held", [0, 150 * 8, 1 << 20])
def test_average_linkage_with_held_and_stored_rounds(spark, monkeypatch, held):
    # Between stored tables, by the driver from the third round or so on, and by the driver from the first one.
    stored, keep = [], C.cut_lineage
    monkeypatch.setattr(C, "HELD_VALUES", held)
    monkeypatch.setattr(C, "ROUND_TILE", 1000)
    monkeypatch.setattr(C, "cut_lineage", lambda rows, name: (stored.append(name), keep(rows, name))[1])
    x = np.vstack([cloud(11, 240, 8), np.zeros((1, 8))])
    progress = []
    got = sorted(tuple(r) for r in C.average_linkage(frame(spark, x), block_rows=64, finish_at=7, progress=progress).collect())
    assert (len(stored) == 2) == (held == 1 << 20)
    assert progress[-1]["clusters"] > 7 and all(p["distances"] == p["clusters"] * p["compared"] for p in progress)
    monkeypatch.setattr(C, "HELD_VALUES", 0)
    want = sorted(tuple(r) for r in C.average_linkage(frame(spark, x), finish_at=500).collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert all(abs(r[2] - s[2]) < 1e-9 for r, s in zip(got, want))
