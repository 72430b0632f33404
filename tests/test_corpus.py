"""Goldens on a stored model-text corpus (read as data; skipped when absent).

Set ``FLOWMATCH_CORPUS`` to a folder holding ``AAO/`` and ``baseline/``
(``<provider>/<pattern>/<ordinal>.txt``) and the expected models in ``EAO/``.

Parse counts and exact-label score summaries were derived independently from
"""

import os

import pytest
from pyspark.sql import functions as F

from flowmatch.operators import batch as B
from flowmatch.operators import parse as P
from flowmatch.sources import models as SM

CORPUS = os.environ.get("FLOWMATCH_CORPUS", "")
pytestmark = pytest.mark.skipif(not CORPUS or not os.path.isdir(os.path.join(CORPUS, "AAO")),
                                reason="corpus absent (set FLOWMATCH_CORPUS)")

PARSE = {"AAO": (366, 863, 720, 247, 1664, 10), "baseline": (495, 1179, 952, 287, 2184, 2)}
# (set, provider, pattern) -> files, overall == 1, mean over files, mean over 64 ordinals, overall == 0
SCORES = {
    ("AAO", "gemini", "AP6"): (35, 20, 0.905776, 0.495346, 0),
    ("AAO", "gemini", "AP18"): (21, 15, 0.910907, 0.298891, 1),
    ("AAO", "gpt", "AP6"): (33, 29, 0.961382, 0.495713, 0),
    ("AAO", "gpt", "AP18"): (45, 23, 0.887432, 0.623976, 0),
    ("AAO", "mistral", "AP6"): (9, 6, 0.930997, 0.130921, 0),
    ("AAO", "mistral", "AP18"): (30, 16, 0.906226, 0.424794, 0),
    ("baseline", "gemini", "AP6"): (56, 36, 0.924253, 0.808721, 0),
    ("baseline", "gemini", "AP18"): (49, 36, 0.939021, 0.718938, 0),
    ("baseline", "gpt", "AP6"): (42, 37, 0.972756, 0.638371, 0),
    ("baseline", "gpt", "AP18"): (54, 28, 0.896809, 0.756683, 0),
    ("baseline", "mistral", "AP6"): (30, 20, 0.896052, 0.420024, 1),
    ("baseline", "mistral", "AP18"): (52, 32, 0.909056, 0.738608, 1),
}


@pytest.mark.parametrize("name", ["AAO", "baseline"])
def test_parse_goldens(spark, name):
    c = SM.read_candidates(spark, os.path.join(CORPUS, name), name)
    p = P.parse_models(c)
    kinds = {r.kind: r["count"] for r in p["nodes"].groupBy("kind").count().collect()}
    f = p["flows"]
    got = (c.count(), kinds["task"], kinds["event"], kinds["gateway"], f.count(),
           f.where(F.col("sourceRef").isNull() | F.col("targetRef").isNull()).count())
    assert got == PARSE[name]


@pytest.mark.parametrize("name", ["AAO", "baseline"])
def test_score_goldens(spark, name):
    exp = SM.read_named(spark, os.path.join(CORPUS, "EAO"))
    c = SM.read_candidates(spark, os.path.join(CORPUS, name), name).where(F.col("pattern").isin("AP6", "AP18"))
    sc = B.score_against_expected(c, exp)
    dense = B.dense_ordinals(sc, ["provider", "pattern"], n=64).groupBy("provider", "pattern").agg(
        F.round(F.avg("similarity"), 6).alias("m64"))
    agg = sc.groupBy("provider", "pattern").agg(
        F.count("*").alias("files"), F.sum(F.col("is_exact").cast("int")).alias("exact"),
        F.round(F.avg("similarity"), 6).alias("mean"), F.sum((F.col("similarity") == 0).cast("int")).alias("zero"))
    for r in agg.join(dense, ["provider", "pattern"]).collect():
        assert (r.files, r.exact, r.mean, r.m64, r.zero) == SCORES[(name, r.provider, r.pattern)]


def test_score_meanings(spark):
    """M8: derive rows get the gate and the candidate's score; NULL meanings
    stay NULL unless carried forward."""
    exp = SM.read_named(spark, os.path.join(CORPUS, "EAO"))
    cands = SM.read_candidates(spark, os.path.join(CORPUS, "AAO"), "AAO").where(
        (F.col("provider") == "gemini") & (F.col("pattern") == "AP6"))
    derived = spark.createDataFrame(
        [("gemini", "AP6", 1, "move A"), ("gemini", "AP6", 2, None), ("gemini", "AP6", 26, " NA "),
         ("gemini", "AP6", 27, "False"), ("gemini", "AP6", 63, "x")],
        "provider string, pattern string, ordinal int, meaning string")
    out = {r.ordinal: r for r in B.score_meanings(derived, cands, exp).collect()}
    assert out[2].meaning_status is None and out[2].similarity is None
    assert out[26].meaning_status is False and out[26].similarity == pytest.approx(0.785714, abs=1e-6)
    assert out[27].meaning_status is False
    assert out[1].meaning_status is True and out[1].similarity is not None
    carried = {r.ordinal: r for r in B.score_meanings(derived, cands, exp, carry=True).collect()}
    assert carried[2].similarity == out[1].similarity and carried[2].meaning_status is True
