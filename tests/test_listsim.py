"""Hand-made list pairs (metrics, weights) and the greedy matching case."""

import pytest
from pyspark.sql import functions as F

from flowmatch.operators import listsim as LS

# (l1, l2, dice, jaccard, precision, recall, f1, weight)
CASES = [
    (["a", "b", "c"], ["a", "b", "d"], 0.666667, 0.5, 0.666667, 0.666667, 0.666667, 3.0),
    (["a", "a", "b"], ["a"], 0.5, 0.333333, 1.0, 0.333333, 0.5, 1.5),
    (["a"], ["a", "a", "a"], 0.5, 0.333333, 0.333333, 1.0, 0.5, 1.5),
    ([], ["a"], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ([], [], 1.0, 1.0, 0.0, 0.0, 0.0, 0.0),
]


def _counts(spark, side):
    rows = [(k, x) for k, case in enumerate(CASES) for x in case[side]]
    df = spark.createDataFrame(rows, "model_id int, label string")
    return df.groupBy("model_id", "label").agg(F.count("*").alias("cnt"))


def test_list_metrics(spark):
    pairs = spark.createDataFrame([(k, k, k) for k in range(len(CASES))], "case int, m1 int, m2 int")
    st = LS.list_stats(pairs, _counts(spark, 0), _counts(spark, 1))
    got = {r["case"]: r for r in st.select("case", *LS.metric_columns()).collect()}
    for k, (_, _, d, j, p, r, f, w) in enumerate(CASES):
        g = got[k]
        assert (g["dice"], g["jaccard"], g["precision"], g["recall"], g["f1"], g["weight"]) == \
            pytest.approx((d, j, p, r, f, w), abs=1e-6), k


def test_greedy_case(spark):
    e = spark.createDataFrame([(0, 0, 0, 0.90), (0, 0, 1, 0.90), (0, 1, 0, 0.95)],
                              "g int, i1 int, i2 int, score double")
    m = LS.greedy_match(e, ["g"], 0.9)
    assert sorted((r.i1, r.i2) for r in m.collect()) == [(0, 1), (1, 0)]


def _greedy_py(edges, thr):
    used1, used2, out = set(), set(), []
    for s, i1, i2 in sorted(edges, key=lambda x: (-x[0], x[1], x[2])):
        if s >= thr and i1 not in used1 and i2 not in used2:
            used1.add(i1)
            used2.add(i2)
            out.append((i1, i2))
    return sorted(out)


def test_greedy_equals_sequential(spark):
    import random
    rnd = random.Random(7)
    rows, want = [], {}
    for g in range(30):
        edges = [(round(rnd.choice([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), 2), i1, i2)
                 for i1 in range(rnd.randint(1, 6)) for i2 in range(rnd.randint(1, 6))]
        want[g] = _greedy_py(edges, 0.7)
        rows += [(g, i1, i2, s) for s, i1, i2 in edges]
    e = spark.createDataFrame(rows, "g int, i1 int, i2 int, score double")
    got = {}
    for r in LS.greedy_match(e, ["g"], 0.7).collect():
        got.setdefault(r.g, []).append((r.i1, r.i2))
    for g in want:
        assert sorted(got.get(g, [])) == want[g], g


def test_greedy_long_chain_checkpoints(spark):
    """A chain where only one edge is locally dominant per round: 20 rounds,
    so the lineage-cutting checkpoints inside the loop are exercised."""
    n = 20
    rows = []
    for k in range(n):
        rows.append((0, k, k, round(1 - 0.01 * (2 * k), 4)))
        if k + 1 < n:
            rows.append((0, k + 1, k, round(1 - 0.01 * (2 * k + 1), 4)))
    e = spark.createDataFrame(rows, "g int, i1 int, i2 int, score double")
    got = sorted((r.i1, r.i2) for r in LS.greedy_match(e, ["g"], 0.0).collect())
    assert got == _greedy_py([(s, a, b) for _, a, b, s in rows], 0.0)
    assert got == [(k, k) for k in range(n)]


def test_greedy_counts_equal_the_single_items(spark):
    import random
    rnd = random.Random(3)
    rows, want = [], {}
    for g in range(25):
        a = {i: rnd.randint(1, 4) for i in range(rnd.randint(1, 5))}
        b = {i: rnd.randint(1, 4) for i in range(rnd.randint(1, 5))}
        score = {(i, j): rnd.choice([0.5, 0.7, 0.8, 0.9]) for i in a for j in b}
        rows += [(g, i, j, s, a[i], b[j]) for (i, j), s in score.items()]
        left_a, left_b, taken = dict(a), dict(b), {}
        for (i, j), s in sorted(score.items(), key=lambda x: (-x[1], x[0])):
            m = min(left_a[i], left_b[j]) if s >= 0.7 else 0
            if m:
                taken[i, j] = m
                left_a[i] -= m
                left_b[j] -= m
        want[g] = taken
    e = spark.createDataFrame(rows, "g int, i1 int, i2 int, score double, a long, b long")
    got = {g: {} for g in want}
    for r in LS.greedy_counts(e, ["g"], 0.7).collect():
        got[r.g][r.i1, r.i2] = r.m
    assert got == want
    assert LS.greedy_counts(e.limit(0), ["g"], 0.7).count() == 0


def test_a_truth_model_in_many_pairs(spark):
    """What one pair matches exactly stays open to the other pairs."""
    pairs = spark.createDataFrame([("t", "c1"), ("t", "c2")], "m1 string, m2 string")
    one = spark.createDataFrame([("t", 0, "x")], "model_id string, i int, label string")
    two = spark.createDataFrame([("c1", 0, "x"), ("c2", 0, "y")], "model_id string, i int, label string")
    sim = spark.createDataFrame([("t", "c1", 0, 0, 1.0), ("t", "c2", 0, 0, 0.99)], "m1 string, m2 string, i1 int, i2 int, score double")
    got = {r.m2: (r.i, r.score) for r in LS.similarity_sfa(pairs, one, two, sim, 0.95).collect()}
    assert got == {"c1": (1, 1.0), "c2": (1, 1.0)}


def test_scores_with_label_vectors(spark):
    from flowmatch.operators import score as S
    rows = [("t", "task_names", x) for x in ("pay bill", "pay bill", "ship")] + [("a", "task_names", x) for x in ("pay bill", "settle invoice", "send")]
    rows += [("b", "task_names", x) for x in ("settle invoice", "settle invoice", "no vector")] + [(m, "task_types", "User") for m in ("t", "a", "b") for _ in range(3)]
    counts = S.label_counts(spark.createDataFrame(rows, "model_id string, category string, label string"))
    vectors = spark.createDataFrame([("pay bill", [1.0, 0.0]), ("settle invoice", [0.99, 0.05]), ("ship", [0.0, 1.0]), ("send", [0.7, 0.7])],
                                    "label string, vector array<double>")
    pairs = spark.createDataFrame([("t", "a"), ("t", "b")], "m1 string, m2 string")
    exact = {r.m2: r.task_names for r in S.score_pairs(pairs, counts).collect()}
    similar = {r.m2: (r.task_names, r.task_types, r.overall) for r in S.score_pairs(pairs, counts, vectors=vectors, threshold=0.95).collect()}
    assert exact == {"a": pytest.approx(1 / 3, abs=1e-6), "b": 0.0}
    assert similar["a"] == pytest.approx((2 / 3, 1.0, 5 / 6), abs=1e-6)
    assert similar["b"] == pytest.approx((2 / 3, 1.0, 5 / 6), abs=1e-6)


def test_expected_model_scored_with_vectors(spark):
    from flowmatch.operators import batch as B
    text = "flowchart LR\n0:startevent:((startevent))-->1:task:({})\n1:task:({})-->2:endevent:((endevent))"
    cands = spark.createDataFrame([("AP6", f"c{i}", text.format(t, t)) for i, t in enumerate(["pay", "settle", "sing"])], "pattern string, model_id string, text string")
    expected = spark.createDataFrame([("AP6", "e", text.format("pay", "pay"))], "pattern string, model_id string, text string")
    flow = lambda t: [f"start  {t}", f"{t}  end"]
    v = [(x, [1.0, 0.0]) for t in ("pay", "settle") for x in [t]] + [("sing", [0.0, 1.0])]
    v += [(x, [1.0, float(k)]) for t in ("pay", "settle") for k, x in enumerate(flow(t))]
    vectors = spark.createDataFrame(v, "label string, vector array<double>")
    exact = {r.model_id: r.similarity for r in B.score_against_expected(cands, expected).collect()}
    similar = {r.model_id: r.similarity for r in B.score_against_expected(cands, expected, vectors=vectors).collect()}
    assert exact["c0"] == similar["c0"] == 1.0 and exact["c1"] == exact["c2"] < 1.0
    assert similar["c1"] == 1.0 and similar["c2"] == exact["c2"]


def test_dense_ordinals_keep_every_scored_row(spark):
    from flowmatch.operators import batch as B
    s = spark.createDataFrame([("p", 0, 0.5), ("p", 70, 0.25), ("q", 3000, 1.0)], "k string, ordinal int, similarity double")
    got = {(r.k, r.ordinal): r.similarity for r in B.dense_ordinals(s, ["k"], n=64).collect()}
    assert len(got) == 2 * 64 + 2 and got["p", 70] == 0.25 and got["q", 3000] == 1.0 and got["q", 5] == 0.0
    assert B.dense_ordinals(s, ["k"], n=2500).count() == 5001
    assert B.dense_ordinals(s, ["k"], n=0).count() == 3


def test_usable_meaning_strips_all_white_space(spark):
    from flowmatch.operators import batch as B
    rows = [("NA\n", False), (" false\t", False), ("\u00a0NA", False), ("fine\n", True), (None, None), ("NAB", True)]
    df = spark.createDataFrame([(m,) for m, _ in rows], "m string")
    assert [r.ok for r in df.select(B.meaning_ok(F.col("m")).alias("ok")).collect()] == [ok for _, ok in rows]
