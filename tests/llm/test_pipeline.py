import public_tokenizers
import pytest

import corpus_pipeline
from flowmatch.llm import bpe, quality
from test_decontam import brute
from test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, over the one before."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d for d, t in by_id(stages[0]).items() if model.score(quality.features(t)[None])[0] >= 0.3}
    assert set(by_id(stages[1])) == want and 0 < len(want) < len(by_id(stages[0]))


def test_dedup_stage(stages):
    texts = by_id(stages[1])
    ids = sorted(texts)
    groups = brute_groups([brute_fingerprint(texts[d], 4) for d in ids], 4)
    assert set(by_id(stages[2])) == {ids[g] for g in groups}


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d for d, _, hit, _ in brute(list(by_id(stages[2]).items()), items) if not hit}
    assert set(by_id(stages[3])) == want


def test_pii_stage(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    changed = {d for d in before if before[d] != after[d]}
    assert changed <= {d for d, t in before.items() if any(c in t for c in "@0123456789=")}


def test_bpe_stage(stages):
    texts = by_id(stages[4])
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert bytes(r.bytes) == texts[r.doc_id].encode() and codec.encode([texts[r.doc_id]]) == [bytes(r.ids)]


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])
