"""Mining whose cost must not outgrow the input."""

import random

import numpy as np

from logloom.operators.templates import _Clusters
from tests.test_template_mining import model, run


def test_stretches_propose_every_cluster_that_takes_an_array():
    rng = np.random.default_rng(5)
    for length, threshold in ((4, 0.75), (9, 0.75), (9, 0.4), (3, 0.0)):
        clusters = _Clusters(length, threshold, [], [])
        for line in range(300):
            x = clusters.encode([str(rng.integers(3)) if rng.random() < 0.5 else str(rng.integers(1000)) for _ in range(length)], -2)
            same = (clusters.grid[:, : clusters.size] == x[:, None]).sum(axis=0)
            taking = np.flatnonzero(clusters.fits[length - same])
            i = clusters.first_fit(x)
            assert i == (taking[0] if len(taking) else -1)
            if i < 0:
                clusters.found(line, x)
            else:
                clusters.generalise(i, x)


def test_arrays_that_hardly_meet_are_mined_in_two_rounds(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(300)]
    texts += [f"{t.rsplit(' ', 1)[0]} tail{i}" for i, t in enumerate(texts[100:160])]
    texts += [f"common words of user u{i} here" for i in range(80)]
    got, mined = run(spark, texts, 0.75, batch=40)
    assert got == model(texts, 0.75)
    assert mined.rounds == 2
