"""Lexical search, licence scans, radix sort and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import queries
from logloom.llm.lexical_search import Corpus, Queries, corpus_statistics, search, sketch
from logloom.llm.license_scan import NOTICES, PHRASES, notices_of, scan_licenses, seeds_of
from logloom.llm.radix_sort import sorted_positions
from logloom.llm.resampling import resample
from logloom.llm.words import crc32_of, hash_of, runs_of_words, words_of

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "...", "A", "É é ÉCOLE École", "a_b a-b A1b2", "日本語 の 文", "x" * 200_000, "word " * 60_000, "\x00nul\x7fdel", "İSTANBUL ſ K", "the " + "y" * 47 + " " + "z" * 48 + " " + "w" * 49]


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def joined(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return df.selectExpr("*", "'x' as _text", "1 as _id", "2 as position", "3 as _row", "4 as item", "'y' as spans", "5 as score")


def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# ---------------------------------------------------------------- words


def test_words_of_odd_texts_and_their_hashes():
    words = words_of(*joined(ODD))
    want = [plain_words(t) for t in ODD]
    assert words.counts.tolist() == list(map(len, want))
    flat = [w.encode() for ws in want for w in ws]
    assert [words.word(i) for i in range(len(words.starts))] == flat
    assert crc32_of(words.text, words.starts, words.sizes).tolist() == list(map(zlib.crc32, flat))
    hashes = hash_of(words.text, words.starts, words.sizes).tolist()
    assert len(set(hashes)) == len(set(flat)) == len(set(zip(hashes, flat, strict=True)))


def test_runs_of_words_stay_in_their_text():
    words = words_of(*joined(["a b c", "", "d", "e f"]))
    starts, sizes, owner = runs_of_words(words, 2)
    got = sorted((o, words.text[s : s + n].tobytes().decode()) for s, n, o in zip(starts.tolist(), sizes.tolist(), owner.tolist(), strict=True))
    assert got == [(0, "a"), (0, "a b"), (0, "b"), (0, "b c"), (0, "c"), (2, "d"), (3, "e"), (3, "e f"), (3, "f")]


# ---------------------------------------------------------------- search


def brute_search(docs, items, k):
    terms = [(i, Counter(plain_words(t))) for i, t in docs]
    held = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in set(plain_words(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        rows.sort(key=lambda r: r[:3])
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(rows[:k], 1)]
    return sorted(out, key=repr)


def test_bounds_are_never_below_the_scores():
    rng = random.Random(2)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(names, k=rng.randint(1, 300))) for _ in range(60)] + ["w1 " * 5000]
    words = words_of(*joined(texts))
    corpus = Corpus(len(texts), int(words.counts.sum()))
    q = Queries([(i, [w.encode() for w in rng.sample([*names, "absent"], 30)]) for i in range(20)])
    q.weigh(corpus, np.array([sum(t.decode() in s.split() for s in texts) for t in q.terms]))
    bounds, scores = q.bounds(*sketch(words, corpus)), q.scores(words, corpus)
    assert (bounds >= scores).all() and scores.any() and bounds.sum() < 1.2 * scores.sum()


def test_terms_of_equal_hash_are_told_apart():
    q = Queries([(0, [b"one", b"two"]), (1, [b"two"])])
    q.hashes = np.zeros(2, np.uint64)
    import logloom.llm.lexical_search as module

    real = module.hash_of
    module.hash_of = lambda text, starts, sizes: np.zeros(len(starts), np.uint64)
    try:
        text, term, tf = q.counted(words_of(*joined(["two one two three", "four"])))
    finally:
        module.hash_of = real
    assert {(q.terms[t], n, i) for i, t, n in zip(text.tolist(), term.tolist(), tf.tolist(), strict=True)} == {(b"one", 1, 0), (b"two", 2, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(names, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(20)] + [docs[3], docs[3], (None, docs[3][1]), *((2000 + i, t) for i, t in enumerate(ODD))]
    items = [(i, " ".join(rng.choices([*names, "absent"], k=8))) for i in range(12)] + [(50, ""), (51, None), (52, "absent"), (53, "École A1b2 日本語")]
    got = search(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id"), k=4, block_items=5, block_terms=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 4)


def test_search_of_nothing(spark):
    some = frame(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search(nothing(spark), items).collect() == []
    assert search(some, items.limit(0)).collect() == []
    assert search(frame(spark, [(1, None), (2, "!")]), items).collect() == []
    # A term that every document holds still has a positive weight.
    assert [tuple(r)[:3] for r in search(some, items).collect()] == [(1, 1, 1)]
    assert corpus_statistics(some) == Corpus(1, 2)


# ---------------------------------------------------------------- licences


def least_edits(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def base_of(text):
    words, out = plain_words(text), []
    for phrase, label in PHRASES:
        parts = phrase.split()
        out += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return sorted(out)


def edited(text, edits, rng):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "q", text[at] + "x"]) + text[at + 1 :]
    return text


def test_one_seed_outlives_any_bounded_edits():
    rng = random.Random(4)
    for notice in notices_of(PHRASES, NOTICES, 10):
        assert "".join(s for s, _ in seeds_of(notice)) == notice.text and len(seeds_of(notice)) == notice.edits + 1
        for _ in range(50):
            changed = edited(notice.text, notice.edits, rng)
            assert any(s in changed for s, _ in seeds_of(notice))


def test_scan_equals_brute_force(spark):
    rng = random.Random(6)
    filler = "lorem the mit under license version apache 2 of free charge public general cc by".split()
    notices = tuple((t, label, "") for t, label, _ in NOTICES)
    docs = []
    for i in range(250):
        text, _, _ = rng.choice(NOTICES)
        parts = rng.choices(filler, k=rng.randint(0, 12))
        parts.insert(rng.randint(0, len(parts)), edited(text, rng.randint(0, len(text) // 12 + 1), rng))
        docs.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    got = {r["doc_id"]: r for r in scan_licenses(frame(spark, docs), notices=notices, chars_per_edit=12).collect()}
    for i, text in docs:
        whole = " ".join(plain_words(text))
        want = {t for t, _, _ in notices if least_edits(t, whole) <= len(t) // 12}
        spans = got[i]["spans"]
        assert {s["notice"] for s in spans if not s["exact"]} | {s["notice"] for s in spans if s["exact"]} >= want, text
        assert {s["notice"] for s in spans if not s["exact"]} <= want, text
        assert sorted((s["first_word"], s["label"]) for s in spans if s["exact"]) == base_of(text)
        assert got[i]["n_words"] == len(plain_words(text))
        for s in spans:
            inner = plain_words(text[s["start"] : s["end"]])
            assert inner == plain_words(text)[s["first_word"] : s["last_word"] + 1]
            assert least_edits(s["notice"], " ".join(inner)) <= s["edits"]


def test_fixed_words_must_stand(spark):
    docs = [(1, "under the mpl license"), (2, "Apache License, Version 1.1"), (3, "Licenced under the MIT Licence"), (4, "Apache Licence, Version 2.0")]
    got = {r["doc_id"]: [(s["label"], s["edits"], s["exact"]) for s in r["spans"]] for r in scan_licenses(frame(spark, docs)).collect()}
    assert got == {1: [], 2: [], 3: [("mit", 1, False)], 4: [("apache-2", 1, False)]}


def test_license_query_and_odd_rows(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "CC-BY-NC 4.0"), (90, "under the MIT license " * 20_000), (91, "é under, the MIT. License\ncc by nc, apache license version 2"), (92, "under the mit licenses")]
    got = sorted(scan_licenses(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert [(s["label"], s["first_word"], s["start"], s["end"]) for s in spans[None]] == [("cc-by-nc", 0, 0, 8)]
    assert len(spans[90]) == 20_000 and spans[90][-1]["first_word"] == 4 * 19_999
    assert [(s["label"], s["first_word"], s["exact"]) for s in spans[91]] == [("mit", 1, True), ("cc-by-nc", 5, True), ("apache-2", 8, True)]
    assert [(s["label"], s["edits"], s["exact"]) for s in spans[92]] == [("mit", 0, False)]
    assert scan_licenses(nothing(spark)).collect() == []
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    told = {r["doc_id"]: r for r in queries.op12_license_scan(spark, SMALL).collect()}
    assert told.keys() == texts.keys() and any(r["n_base"] for r in told.values())
    for i, text in texts.items():
        base, r = base_of(text), told[i]
        assert (r["n_words"], r["n_base"]) == (len(plain_words(text)), len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= bool(base) and bool(r["score"]) == bool(r["labels"])


# ---------------------------------------------------------------- radix sort, resampling


@pytest.mark.parametrize("bits, block", [(3, 7), (11, 64), (11, 1 << 15)])
def test_radix_positions_equal_a_sort(spark, bits, block):
    rng = random.Random(bits)
    rows = [(rng.randint(-50, 50), rng.choice([5, 5, 5, rng.randint(-(10**12), 10**12)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b bigint, c bigint").repartition(5)
    got = sorted(map(tuple, sorted_positions(df, ["a", "b"], digit_bits=bits, block_rows=block).collect()), key=lambda r: r[3])
    assert [r[3] for r in got] == list(range(400))
    assert [r[:2] for r in got] == sorted(r[:2] for r in rows) and sorted(r[:3] for r in got) == sorted(rows)


def test_radix_of_extreme_keys_and_nothing(spark):
    ends = [-(2**63), 2**63 - 1, 0, -1, 1, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(e,) for e in ends], "a bigint")
    got = sorted(sorted_positions(df, ["a"], digit_bits=16).collect(), key=lambda r: r["position"])
    assert [r["a"] for r in got] == sorted(ends)
    assert sorted_positions(df.limit(0), ["a"]).collect() == []
    assert sorted(r["position"] for r in sorted_positions(spark.createDataFrame([(7,)] * 5, "a int"), ["a"]).collect()) == list(range(5))


def brute_resample(docs, target, longest, buckets, percent, least, seed):
    def features(text):
        ws = plain_words(text)
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in target for f in features(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in features(x))
        rows.append([i, len(plain_words(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resample_equals_brute_force(spark, longest):
    rng = random.Random(longest)
    docs = [(i, " ".join(rng.choices("a b c d e f g h É 日".split(), k=rng.randint(0, 40)))) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), *((500 + i, t) for i, t in enumerate(ODD))]
    target = ["a a b c", None, "日 h h h", ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame(spark, docs), items, longest_run=longest, buckets=50, percent=30, least_words=5, seed=9, block_rows=32)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target, longest, 50, 30, 5, 9)


def test_resample_of_nothing(spark):
    items = spark.createDataFrame([("a",)], "text string")
    assert resample(nothing(spark), items).collect() == []
    alone = resample(frame(spark, [(1, "a " * 30), (2, None)]), items.limit(0), percent=100).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in alone} == {(1, 59, 1), (2, 0, None)}


def test_resampling_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(r[0], *r[2:]) for r in brute_resample(docs, target, 1, 10_000, 10, 20, 2024)}
    assert set(map(tuple, queries.op13_importance_resampling(spark, SMALL).collect())) == want


def test_search_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op11_lexical_search(spark, SMALL).collect()), key=repr) == brute_search(docs, items, 10)
    assert queries.op11_lexical_search(spark, SMALL).agg(F.max("rank")).first()[0] == 10
