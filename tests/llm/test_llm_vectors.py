"""Near-duplicate vectors and nearest neighbours against brute force."""

import numpy as np
import pytest

from logloom.llm import embedding_dedup, queries
from logloom.llm.ann_forest import LEAST, SHARE, TREES, Forest, Shard, nearest_by_product
from logloom.llm.embedding_dedup import near_duplicate_vectors, passes_needed, window_links

SMALL = "/root/testdata/sf0.001"


def brute_links(rows, cosine):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    near = {i: set() for i, _ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= cosine:
                links[i] += 1
                links[j] += 1
                near[i].add(j)
                near[j].add(i)
    for i in sorted(label):
        todo = [i] if label[i] == i else []
        while todo:
            for b in near[todo.pop()]:
                if label[b] > i:
                    label[b] = i
                    todo.append(b)
    return {i: (links[i], label[i], label[i] == i) for i in links}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, _v double, component string").repartition(3)


@pytest.mark.parametrize(("window", "tile"), [(128, 2048), (4, 8)])
def test_links_of_groups_copies_and_odd_vectors(spark, monkeypatch, window, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = []
    for center in rng.normal(size=(12, 16)):
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (center + rng.normal(size=16) * 0.05).tolist()))
    rows += [(500 + k, rows[3][1]) for k in range(5)] + [(510, (np.array(rows[3][1]) * 1e100).tolist()), (511, (np.array(rows[3][1]) * 1e-100).tolist())]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] + [1.0] * 15), (604, [float("inf")] * 16), (605, [])]
    got = near_duplicate_vectors(frame(spark, rows), window=window, recall=0.9999).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_links(rows, 0.9)
    assert len(got) == len(rows)


def test_dedup_query_and_empty(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = queries.op1_embedding_dedup(spark, SMALL).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_links(rows, 0.9)
    assert near_duplicate_vectors(frame(spark, [])).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    got = near_duplicate_vectors(frame(spark, rows)).collect()
    assert len(got) == 4
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)]
    assert {r["component_id"] for r in got if r["vec_id"] == 2} == {1}


def test_passes_follow_the_rows():
    assert passes_needed(100, 0.9) == 1
    assert passes_needed(10**4, 0.9) < passes_needed(10**6, 0.9) < passes_needed(10**8, 0.9)


def test_window_links_are_those_of_all_near_rows():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(70, 3))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    u, v = window_links(np.arange(70), unit, 0.8, 7)
    want = {(i, j) for i in range(70) for j in range(i + 1, min(i + 8, 70)) if unit[i] @ unit[j] >= 0.8}
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == want


def brute_nearest(rows, k, query):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, x in good:
        if query(i):
            out[i] = [j for _, j in sorted((-(x @ y), j) for j, y in good if j != i)[:k]]
    return out


def recall(got, want):
    found = {q: [] for q in want}
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    return np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(300, 30), (100_000, 100_000)])
def test_nearest_recall_on_several_shards(spark, shard_rows, query_rows):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2000, 24)) * rng.uniform(0.2, 3, size=(2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = nearest_by_product(frame(spark, rows), lambda i: i % 20 == 0, shard_rows=shard_rows, query_rows=query_rows, least=50).collect()
    assert recall(got, brute_nearest(rows, 20, lambda i: i % 20 == 0)) >= 0.9
    for r in got[:200]:
        assert abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-9 and r["query_id"] != r["vec_id"]


@pytest.mark.parametrize("norms", ["one", "outlier", "lognormal 0.5", "lognormal 1"])
def test_recall_does_not_fall_with_uneven_norms(norms):
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(10_000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    size = np.ones(len(unit)) if norms in ("one", "outlier") else np.exp(rng.normal(size=len(unit)) * float(norms.split()[1]))
    size[77] *= 2 if norms == "outlier" else 1
    vectors, asked = unit * size[:, None], np.arange(0, 10_000, 200)
    found = Shard(np.arange(10_000), vectors, TREES, 23, SHARE, LEAST).search(asked, vectors[asked], 20)
    score = vectors[asked] @ vectors.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = [set(row.tolist()) for row in np.argsort(-score, axis=1)[:, :20]]
    assert np.mean([len(w & set(v.tolist())) / 20 for w, (_, v, _) in zip(want, found, strict=True)]) >= 0.95


def test_nearest_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = queries.op3_ann_forest(spark, SMALL).collect()
    assert recall(got, brute_nearest(rows, 20, lambda i: i % 20 == 0)) >= 0.9


def test_nearest_ties_few_rows_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [2.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (None, [9.0, 9.0]), (80, [-1.0, 0.0])]
    got = nearest_by_product(frame(spark, rows), lambda i: i % 20 == 0).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 80)}
    assert by[0] == [(1, 2.0), (2, 1.0), (3, 1.0), (80, -1.0)]
    assert by[80] == [(0, -1.0), (2, -1.0), (3, -1.0), (1, -2.0)]
    assert {r["query_id"] for r in got} == {0, 80}
    assert nearest_by_product(frame(spark, []), lambda i: i % 20 == 0).collect() == []


def test_prefix_ranges_hold_all_rows_with_the_prefix():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    forest = Forest(np.arange(300), vectors, float(np.linalg.norm(vectors, axis=1).max()), 3, 1)
    strings = forest.strings[1]
    for depth in (0, 1, 5, 12, 48):
        begin, end = forest._range(strings[:20], 1, depth)
        for s, b, e in zip(strings[:20], begin, end, strict=True):
            assert np.array_equal(np.flatnonzero(strings >> (48 - depth) == s >> (48 - depth)), np.arange(b, e))
    met = forest.candidates(vectors[:10], 120)
    assert (met.sum(axis=1) >= 120).all() and met[np.arange(10), np.arange(10)].any()
