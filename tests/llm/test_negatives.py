import math

import numpy as np
import pytest

from flowmatch.llm import negatives
from flowmatch.llm.queries import QUERIES
from flowmatch.sources.tables import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    fine = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        fine[vec_id] = ([math.floor(256 * x) for x in vec], (label + 1) % 10 if vec_id % 7 == 0 else label)
    out = []
    for a, (v, label) in fine.items():
        if a % 100:
            continue
        order = sorted(((-sum(x * y for x, y in zip(v, w)), b, own) for b, (w, own) in fine.items() if b != a))
        for ps, p, _ in [x for x in order if x[2] == label][:5]:
            hard = [(b, -s) for s, b, own in order if own != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, k + 1, b, -ps, s) for k, (b, s) in enumerate(hard)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_all_rows_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "TABLES", 2)
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = QUERIES["op12_hard_negatives"](spark, SF)
    assert found.columns == COLUMNS
    assert as_rows(found) == brute(rows) != []


def test_ties_signs_and_odd_lengths(spark):
    rnd = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rnd.integers(-2, 3, int(rnd.integers(9, 14))) / 4], int(i % 3)) for i in range(0, 700, 2)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_rows(negatives.mine(docs)) == brute(rows) != []


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 2), (2, [0.5, 0.5], 3), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
            (None, [1.0, 1.0], 2), (8, [1.0, 1.0], None), (100, [], 2), (9, [-1.0, -1.0], 2)]
    docs = spark.createDataFrame([(*r, 1, [2]) for r in rows], "vec_id long, embedding array<float>, label int, row int, vec array<int>")
    assert as_rows(negatives.mine(docs)) == brute(rows) != []
    for few in (docs.where("vec_id = -1"), docs.where("vec_id = 2"), docs.where("vec_id = 100")):
        assert as_rows(negatives.mine(few)) == []
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int"))


def test_lookups_are_inner_products():
    rnd = np.random.default_rng(1)
    for top, dtype in ((3, np.int32), (300, np.int32), (10 ** 6, np.int64)):
        a, c = rnd.integers(-top, top + 1, (5, 24)), rnd.integers(-top, top + 1, (40, 24))
        found = negatives.scores(negatives.subset_sums(a, dtype), negatives.bit_planes(c, top.bit_length() + 1))
        assert (found == c @ a.T).all()
