"""Mining that moves no array where a length has a few clusters, and splits words without a pattern per row."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.patterns import BLANKS, OUTER_BLANKS, STAMP
from logloom.functions.text import strip, tokenize
from logloom.operators import templates as T
from logloom.operators.numbering import shared_folder
from tests.test_template_mining import W, frame, messages, model, run


def test_few_clusters_go_to_the_arrays(spark, monkeypatch):
    rng = random.Random(2)
    kinds = ["user {} came from {} at noon by the road", "disk {} lost block {} of the last good copy"]
    texts = [rng.choice(kinds).format(rng.randrange(10**6), rng.randrange(10**6)) for _ in range(300)]
    texts += ["user 1 came from 2 at noon by some way", "an own shape of nine words to be found"]

    def moved(*_):
        raise AssertionError("arrays were moved")

    monkeypatch.setattr(T, "accepting", moved)
    got, mined = run(spark, texts, 0.75, batch=40)
    assert got == model(texts, 0.75)
    assert mined.rounds == 2


@pytest.mark.parametrize("threshold", [0.75, 0.5])
def test_few_clusters_take_what_the_index_finds(spark, threshold):
    rng = random.Random(4)
    words = lambda n, w: [W if rng.random() < w else rng.choice("ab") + str(i) for i in range(n)]
    arrays = spark.createDataFrame([(n, i, words(n, 0.05)) for i, n in enumerate(rng.choices((4, 8, 9), k=400))], "n_tok int, first_line bigint, tokens array<string>")
    most = lambda n: max(d for d in range(n + 1) if 1 - d / n >= threshold)
    states = [(n, 1000 + i, words(n, 0.15)) for i, n in enumerate([4, 8] * 6)]
    states = spark.createDataFrame([s for s in states if s[2].count(W) <= most(s[0])], "n_tok int, founder bigint, tokens array<string>")
    want = sorted(map(tuple, T.accepting(arrays, states, threshold).collect()))
    taken = T._taken_where_they_are(arrays.withColumn("text", F.array_join("tokens", " ")), T._few_states(states, 6, threshold), threshold)
    assert want and sorted(map(tuple, taken.select("first_line", F.inline("takers")).collect())) == want
    assert taken.count() == 400
    assert T._few_states(states, 1, threshold) is None


def test_many_and_few_clusters_match_model(spark, monkeypatch):
    texts = messages(41, 120)
    monkeypatch.setattr(T, "FEW", 1000)
    got, mined = run(spark, texts, 0.75, batch=20)
    assert got == model(texts, 0.75)
    assert mined.rounds > 1


def test_words_of_plain_and_odd_texts(spark):
    rng = random.Random(3)
    odd = [" ", "  ", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "b", "\x7f", "é", ":", "/", "2016/9/27:20:30:31"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(400)] + [" a", "a ", "a b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.coalesce("t", F.lit("")), STAMP, f" {W} ")
    assert df.filter(~tokenize(F.col("t")).eqNullSafe(F.array_remove(F.split(plain, BLANKS), ""))).isEmpty()
    assert df.filter(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", OUTER_BLANKS, ""))).isEmpty()
    assert r"　]+" not in df.select(tokenize(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_only_tables_of_the_result_stay(spark):
    def tables():
        folder = shared_folder(spark).removeprefix("file:") + "/logloom"
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before, texts = tables(), [*messages(7, 120), f"{W} {W} c d"]
    got, mined = run(spark, texts, 0.75, batch=20)
    mined = T.mine_templates(frame(spark, texts), 0.75, 20)
    stay = {name.rsplit("-", 1)[0] for name in tables() - before}
    assert mined.rounds > 1 and mined.lone is not None
    assert not stay & {"arrays", "keys", "edges", "left", "mined", "tested", "accepted", "fresh", "known"}
    # The result is read after the other tables have gone.
    assert got == model(texts, 0.75)
    assert mined.lone.count() and mined.versions.count() and mined.assignments.count()
