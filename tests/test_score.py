"""Pair scores with the counts of few expected models apart."""

from flowmatch.operators import score as S
from flowmatch.session import counted_broadcast


def test_truth_apart_gives_the_same_scores(spark):
    labels = [(m, "task_names", f"t{(m * k) % 5}") for m in range(60) for k in range(4)] + [(m, "seq_flows", f"f{m % 3}") for m in range(1, 60)]
    counts = S.label_counts(spark.createDataFrame(labels, "model_id long, category string, label string")).localCheckpoint()
    pairs = spark.createDataFrame([(m % 2, m) for m in range(60)], "m1 long, m2 long")
    truth = counted_broadcast(counts.where("model_id < 2"))
    with_truth = S.score_pairs(pairs, counts, pairs_unique=True, truth=truth)
    assert sorted(with_truth.collect()) == sorted(S.score_pairs(pairs, counts, pairs_unique=True).collect())
    # the pairs of an expected model are never gathered by it
    plan = with_truth._jdf.queryExecution().executedPlan().toString()
    assert all("m2#" in x.split(")")[0] for x in plan.split("hashpartitioning(m1#")[1:])


def test_only_small_tables_are_broadcast(spark):
    df = spark.range(10).localCheckpoint()
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(counted_broadcast(df, 10)) and not hinted(counted_broadcast(df, 9))


def test_gate_of_documents_without_their_texts(spark, tmp_path):
    """The compare rows are joined without texts, and gated as the rows that have them."""
    from pyspark.sql import functions as F

    from flowmatch.operators import batch as B
    from flowmatch.plans import q_flow as Q
    docs = [(0, "a", "en", "a text"), (1, "a", "de", None), (2, "b", "en", " NA "), (3, "b", "en", "x"), (4, "b", "en", "FALSE\n"), (5, "c", "en", "y"), (6, "c", "en", None)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, None), (6, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q._doc_status(spark, str(tmp_path))
    want = Q._doc_rows(spark, str(tmp_path)).select("doc_id", "provider", "pattern", "mapping", "epap", B.meaning_ok(F.col("meaning")).alias("meaning_status"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    joined = got._jdf.queryExecution().analyzed().toString().split("Join")[1]
    assert "_ok#" in joined  # gated below the join
