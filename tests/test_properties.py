"""Scoring against a brute-force scorer on random multisets, and metric identities."""

import random

import pytest
from pyspark.sql import functions as F

from flowmatch.operators import score as S

CATS = S.CATEGORIES


def _indexed(xs):
    seen, out = {}, []
    for x in xs:
        k = seen.get(x, 0)
        out.append((x, k))
        seen[x] = k + 1
    return out


def _brute(l1, l2):
    """Exact-label list similarity the slow way: occurrence-indexed sets."""
    a, b = set(_indexed(l1)), set(_indexed(l2))
    n1, n2, i = len(a), len(b), len(a & b)
    if n1 + n2 == 0:
        return 1.0, 0.0
    return 2 * i / (n1 + n2), 2 * n1 * n2 / (n1 + n2)


def _overall(m1, m2):
    num = den = 0.0
    for c in CATS:
        s, w = _brute(m1.get(c, []), m2.get(c, []))
        num += s * w
        den += w
    return 0.0 if den == 0 else num / den


def _random_model(rnd):
    return {c: [rnd.choice("abcd") for _ in range(rnd.randint(0, 5))] for c in CATS if rnd.random() < 0.7}


def test_overall_matches_brute_force(spark):
    rnd = random.Random(11)
    models = {m: _random_model(rnd) for m in range(40)}
    rows = [(m, c, x) for m, d in models.items() for c, xs in d.items() for x in xs]
    labels = spark.createDataFrame(rows, "model_id int, category string, label string")
    counts = S.label_counts(labels)
    pairs_l = [(a, rnd.randrange(40)) for a in range(40)] + [(a, a) for a in range(5)]
    pairs = spark.createDataFrame(pairs_l, "m1 int, m2 int")
    got = {(r.m1, r.m2): r for r in S.score_pairs(pairs, counts, digits=None).collect()}
    for a, b in pairs_l:
        assert got[(a, b)].overall == pytest.approx(_overall(models[a], models[b]), abs=1e-12)
        if a == b and any(models[a].values()):
            assert got[(a, b)].overall == 1.0 and got[(a, b)].is_exact


def test_metric_identities(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 6), rnd.randint(0, 6)) for _ in range(200)]
    rows = [(n1, n2, rnd.randint(0, min(n1, n2))) for n1, n2 in rows]
    df = spark.createDataFrame(rows, "n1 long, n2 long, i long")
    from flowmatch.functions import metrics as M
    n1, n2, i = F.col("n1"), F.col("n2"), F.col("i")
    out = df.select("n1", "n2", "i", M.dice(n1, n2, i).alias("d"), M.jaccard(n1, n2, i).alias("j"),
                    M.precision(n1, n2, i).alias("p"), M.recall(n1, n2, i).alias("r"),
                    M.precision(n2, n1, i).alias("p_swapped"), M.dice(n2, n1, i).alias("d_swapped"))
    for r in out.collect():
        assert r.d == pytest.approx(r.d_swapped)
        assert r.r == pytest.approx(r.p_swapped)
        if r.n1 + r.n2 > 0:
            assert r.j == pytest.approx(r.d / (2 - r.d))
