"""Counts of noised texts against their references."""

import random
from collections import Counter

import numpy as np

from patchwright.operators import metrics as M
from patchwright.operators import noise as N
from patchwright.plans import quality as Q

ODD = ["", " ", ".", "a.", ".a", "..", "ि", "ि ि a.", "काला, पीला।", "\x1c.a\x85b,", "😀 a" * 3, "ab" * 400]


def grams(x, n):
    return Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))


def orders(text):
    return [grams("".join(text.split()), n) for n in range(1, 7)] + [grams(M.chrf_words(text), n) for n in (1, 2)]


def test_noised_chrf_against_counters():
    random.seed(7)
    texts = ODD + ["".join(random.choice("ab. ,िक") for _ in range(random.randint(0, 30))) for _ in range(300)]
    keys = np.arange(len(texts)) - 3
    points, at = N.decoded(texts)
    counted = M.Noised(points, at)
    for share, seed in ((0.0, 1), (0.1, 1), (0.2, 2), (1.0, 3)):
        hyps = N.encoded(*N.noised(points, at, keys, share, seed))
        got = counted.counts(N.hits(at, keys, seed), share) if share else counted.same()
        for i, (h, r) in enumerate(zip(hyps, texts)):
            assert [tuple(x) for x in got[i]] == [(a.total(), b.total(), (a & b).total()) for a, b in zip(orders(h), orders(r))]


def test_squares_at_the_ends():
    x = np.array([0, 1, 2, N.PRIME - 1, N.PRIME - 2, N.PRIME // 2], np.int64)
    for a in (40014, 40692, 48271):
        assert N.squared(x, a).tolist() == [(v * v + a * v + 1) % N.PRIME for v in x.tolist()]


def test_sums_are_those_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(M, "NOISED_BLOCK", 40)
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "id bigint, t string").repartition(3)
    what, cells = ("chrf", "bleu"), [(42, 0.0), (42, 0.2), (43, 0.2)]
    score = lambda c: {(r["seed"], r["noise"]): (r["c"], r["b"]) for r in c.groupBy("seed", "noise").agg(M.chrf_score(M.chrf_sums()).alias("c"), M.bleu_score().alias("b")).collect()}
    want = score(M.noised_counts(df, "id", "t", cells, what))
    assert set(want) == set(cells) and score(M.noised_sums(df, "id", "t", cells, what)) == want
    assert score(M.noised_sums(df.where("t is null"), "id", "t", cells, what)) == {}


def test_metric_rows_count_the_texts_once(spark, sf):
    for q in (Q.metric_curve, Q.metric_pivot):
        assert "MapInArrow" not in q(spark, sf)._jdf.queryExecution().toString()
