"""Threshold joins against brute force, the label encoder, matching in one plan."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmatch.operators import listsim as LS
from flowmatch.operators import score as S
from flowmatch.operators import simjoin as J
from flowmatch.operators.encode import encode_labels
from flowmatch.sources.tables import table

SF = "/root/testdata/sf0.1"


def brute_cosine(x, y, t):
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    return {(i, j) for i, j in zip(*np.nonzero(u @ v.T >= t))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_cosine_join_on_all_embeddings(spark):
    e = table(spark, SF, "embeddings").select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector"))
    rows = e.collect()
    x = np.array([r.vector for r in rows], float)
    for t, share in ((0.45, 0.1), (0.6, 0.01), (0.95, 0.001)):
        got = J.cosine_join(e, e, t).collect()
        assert {(r.l1, r.l2) for r in got} == {(rows[i].label, rows[j].label) for i, j in brute_cosine(x, x, t)}
        # whole products are summed for a small share of all pairs only
        assert max(r.scored for r in got) <= share * len(rows) ** 2


def test_cosine_join_skips_far_cells(spark, monkeypatch):
    """Clustered vectors: cells beyond the triangle bound are never met."""
    monkeypatch.setattr(J, "CELL_ROWS", 50)
    monkeypatch.setattr(J, "CHUNK", 64)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 24))
    x = np.repeat(centres, 50, axis=0) + rnd.normal(scale=0.05, size=(600, 24))
    df = spark.createDataFrame([(str(i), [float(z) for z in v]) for i, v in enumerate(x)], "label string, vector array<double>")
    got = J.cosine_join(df, df, 0.97).collect()
    assert {(int(r.l1), int(r.l2)) for r in got} == brute_cosine(x, x, 0.97)
    assert sum({(r.scored) for r in got}) < 600 * 600


def test_cosine_edges(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [2.0, 0.0, 0.0]), ("e", [float("nan"), 1.0]), ("f", [0.0, -1.0]), ("g", [])]
    df = spark.createDataFrame(rows, "label string, vector array<double>")
    got = {(r.l1, r.l2): r.score for r in J.cosine_join(df, df, 0.0).collect()}
    assert got == {("a", "a"): 1.0, ("a", "d"): 1.0, ("d", "a"): 1.0, ("d", "d"): 1.0, ("f", "f"): 1.0, ("a", "f"): 0.0, ("f", "a"): 0.0, ("d", "f"): 0.0, ("f", "d"): 0.0}
    assert J.cosine_join(df.limit(0), df, 0.5).count() == J.cosine_join(df, df.limit(0), 0.5).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.9, 1.0])
def test_edit_join_as_brute_force(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8))) for _ in range(60)] + ["a" * n for n in (1, 2, 5, 6, 30, 33)]
    for base in ("check the order", "ship the order", "send an invoice to the customer"):
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(["", "x", "ee"])
            words.append("".join(w))
    one, two = words[::2], words[1::2] + words[:10] + [""]
    left, right = (spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((one, "l1"), (two, "l2")))
    got = {(r.l1, r.l2): r.score for r in J.by_edits()(left, right, threshold).collect()}
    want = {}
    for a in set(one):
        for b in set(two):
            s = 1 - edits(a, b) / max(len(a), len(b))
            if s >= threshold:
                want[a, b] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_scores_with_another_similarity(spark):
    """A misspelt label matches by edits, and equal labels before it."""
    labels = [("x", "task_names", n) for n in ("check order", "ship order", "pay")] + [("y", "task_names", n) for n in ("chek order", "ship order", "refund")]
    counts = S.label_counts(spark.createDataFrame(labels, "model_id string, category string, label string"))
    pairs = spark.createDataFrame([("x", "y")], "m1 string, m2 string")
    exact = S.score_pairs(pairs, counts).first()
    similar = S.score_pairs(pairs, counts, similarity=J.by_edits(), threshold=0.8).first()
    assert round(exact.task_names, 6) == 0.333333 and round(similar.task_names, 6) == 0.666667
    vectors = spark.createDataFrame([("check order", [1.0, 0.0]), ("chek order", [1.0, 0.1]), ("pay", [0.0, 1.0])], "label string, vector array<double>")
    for kw in ({"vectors": vectors}, {"similarity": J.by_cosine(vectors)}):
        assert round(S.score_pairs(pairs, counts, threshold=0.9, **kw).first().task_names, 6) == 0.666667


def test_fold_equals_rounds(spark):
    rnd = random.Random(5)
    rows, amount = [], {}
    for g in range(40):
        for i in range(6):
            for j in range(7):
                if rnd.random() < 0.6:
                    a, b = (amount.setdefault((g, s, k), rnd.randrange(1, 4)) for s, k in (("a", i), ("b", j)))
                    rows.append((g, f"p{i}", j, rnd.randrange(5) / 4, a, b))
    e = spark.createDataFrame(rows, "g int, i1 string, i2 int, score double, a long, b long").repartition(3)
    one = sorted(map(tuple, LS.greedy_fold(e, ["g"], 0.5).select("g", "i1", "i2", "score", "m").collect()))
    assert one == sorted(map(tuple, LS.greedy_counts(e, ["g"], 0.5).select("g", "i1", "i2", "score", "m").collect())) != []
    assert LS.greedy_fold(e.limit(0), ["g"], 0.5).count() == 0


def test_labels_are_encoded_once_over_two_runs(spark):
    d = tempfile.mkdtemp(prefix="fm-encode-")
    calls = os.path.join(d, "calls")
    os.makedirs(calls)

    def encoder():
        import uuid

        def encode(labels):
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(labels))
            return [[len(x), 1] for x in labels]
        return encode
    first = spark.createDataFrame([(f"label {i % 30}",) for i in range(300)] + [(None,)], "name string")
    got = encode_labels(first, encoder, d + "/store", label="name", batch=4)
    assert {r.label: r.vector for r in got.collect()} == {f"label {i}": [float(len(f"label {i}")), 1.0] for i in range(30)}
    more = spark.createDataFrame([(f"label {i}",) for i in range(20, 50)], "label string")
    assert encode_labels(more, encoder, d + "/store").count() == 30
    asked = [x for f in os.listdir(calls) for x in open(os.path.join(calls, f)).read().split("\n")]
    assert sorted(asked) == sorted(f"label {i}" for i in range(50))
    n = len(os.listdir(calls))
    assert encode_labels(first, encoder, d + "/store", label="name").count() == 30 and len(os.listdir(calls)) == n


def test_rows_are_copied_once_a_bundle(spark, monkeypatch):
    """Cells that all meet: a row goes to each bundle, not to each cell and chunk of it."""
    monkeypatch.setattr(J, "CELL_ROWS", 20)
    monkeypatch.setattr(J, "CHUNK", 10)
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(str(i), [float(z) for z in v]) for i, v in enumerate(x)], "label string, vector array<double>")
    got = J.cosine_join(df, df, 0.6)
    assert {(int(r.l1), int(r.l2)) for r in got.collect()} == brute_cosine(x, x, 0.6)
    bundles = J._bundles({c: 20 for c in range(20)}, np.zeros((20, 20)), 100)
    assert sorted(b for b, in bundles.values()) == sorted([0, 1, 2, 3] * 5)
    assert sorted(map(len, J._bundles({0: 30, 1: 250, 2: 40}, np.zeros((3, 3)), 100).values())) == [1, 1, 3]
    split = got._jdf.queryExecution().analyzed().toString()
    assert split.count("explode(others") == 2  # one copy for each bundle that a row's own may meet


def test_a_table_with_itself_is_compared_once(spark, monkeypatch):
    """Half the products give the pairs of all, also for rows of one label."""
    monkeypatch.setattr(J, "TILE", 64)
    x = np.random.default_rng(6).normal(size=(300, 8))
    df = spark.createDataFrame([(str(i % 298), [float(z) for z in v]) for i, v in enumerate(x)], "label string, vector array<double>")
    got, other = J.cosine_join(df, df, -0.5).collect(), J.cosine_join(df, df.select("*"), -0.5).collect()
    assert sorted((r.l1, r.l2, r.score) for r in got) == sorted((r.l1, r.l2, r.score) for r in other)
    assert len(got) == len(brute_cosine(x, x, -0.5))
    assert max(r.scored for r in got) <= 0.65 * 300 * 300 == 0.65 * max(r.scored for r in other)


@pytest.mark.parametrize("n, m, d, t", [(700, 600, 64, 0.45), (513, 20, 65, 0.2), (30, 600, 7, -0.5), (1, 9, 1, 1.0), (0, 5, 8, 0.5)])
def test_near_products_in_single_precision(n, m, d, t):
    """Tiles with edges, pairs at the threshold itself, and few pairs beyond the margin."""
    rnd = np.random.default_rng(n)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rnd.normal(size=(k, d)) for k in (n, m)))
    if n and d > 1:  # a pair that is at the threshold
        x[0], y[0] = np.eye(1, d), 0
        y[0, :2] = t, (1 - t * t) ** 0.5
    found = [(i, j) for part in J.near_products(x, y, t) for i, j in zip(part[0].tolist(), part[1].tolist())]
    want = set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= t))))
    assert len(set(found)) == len(found) and want <= set(found)
    assert all(x[i] @ y[j] >= t - 1e-4 for i, j in found) and (not n or d == 1 or (0, 0) in found)


def test_pairs_of_bundles_are_dealt_evenly(spark):
    keys = spark.createDataFrame([(k,) for k in J._even_keys(spark, 40)], "k int").repartition(40, "k")
    assert keys.select(F.spark_partition_id()).distinct().count() == 40
