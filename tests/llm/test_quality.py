import zlib

import numpy as np

from flowmatch.llm import quality
from flowmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_quality_classifier"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = quality.train(docs, labels)
    b = quality.train(docs, labels.where(~quality.held_out()))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "fine words in a row"), (3, "fine words in a row"), (None, "!!" * 9), (4, "long " * 90000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    for labels in ([], [(3, 1, None)], [(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)]):
        marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = quality.train(docs, marked)
        found = quality.scores(docs, model).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        kept = quality.keep_good(docs, model)
        assert kept.dtypes == docs.dtypes and kept.count() == sum(r.score >= quality.THRESHOLD for r in found)
    assert quality.scores(docs.limit(0), quality.train(docs.limit(0), marked)).count() == 0


def test_risk_is_driven_down_without_negatives():
    rnd = np.random.default_rng(1)
    good, bad = rnd.normal(1, 1, (2000, 5)), rnd.normal(-2, 1, (300, 5))
    model = quality.fit(good[:500], np.concatenate([good[500:], bad]), 1500 / 1800)
    assert (model.score(good) >= 0.3).mean() > 0.97 and (model.score(bad) < 0.3).mean() > 0.97


def test_prior_is_estimated_without_negatives(spark):
    rnd = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        good, bad = rnd.normal(1, 1, (4000, 6)), rnd.normal(-1.5, 1, (4000, 6))
        n = int(4000 * share)
        unlabelled = rnd.permutation(np.concatenate([good[:n], bad[:4000 - n]]))
        assert abs(quality.estimate_prior(rnd.normal(1, 1, (2000, 6)), unlabelled) - share) < 0.08
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    true = labels.toPandas().quality.mean()
    model = quality.train(docs, labels)
    assert abs(model.prior - true) < 0.1
    # what the labels that are not 1 say is never read, nor which documents they mark
    only = quality.train(docs, labels.where("quality = 1"))
    assert np.array_equal(model.weight, only.weight) and model.prior == only.prior


def test_scores_as_brute_force(spark):
    """Every score from the text alone, by the model's numbers one after the other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    for d in docs.collect():
        f = model.bias
        for x, mean, scale, weight in zip(quality.features(d.text), model.mean, model.scale, model.weight):
            f += max(-8.0, min(8.0, (x - mean) / scale)) * weight
        assert abs(got.pop(d.doc_id) - 1 / (1 + np.exp(-f))) < 1e-9
    assert not got
