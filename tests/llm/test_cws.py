import hashlib
from collections import Counter

from flowmatch.llm import cws
from flowmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def weights(text):
    return {w: n * len(w) for w, n in Counter((text or "").lower().split()).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op2_consistent_weighted_sampling"](spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(ids)
    errors, prints = [], {}
    for i, d in enumerate(ids):
        text, after, r = texts[d], texts[ids[(i + 1) % len(ids)]], rows[d]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 4 * cws.SAMPLES
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "same words here"), (4, "same words here"), (4, "same words here"), (None, "x y z"), (9, "long word " * 40000), (10, "\n")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, term string")
    found = cws.edited_likeness(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[3].samples == by[4].samples == by[3].next_samples or by[3].samples == by[4].samples
    assert set(by[1].samples) == set(by[2].samples) == {cws.EMPTY} and by[1].n_chars == 0
    # descending: 10 9 4 4 3 2 1 null, then 10 again
    assert by[2].next_samples == by[1].samples and by[1].next_samples == by[None].samples and by[None].next_samples == by[10].samples
    assert by[10].next_samples == by[9].samples
    assert cws.edited_likeness(docs.limit(0)).count() == 0
    one = cws.edited_likeness(docs.where("doc_id = 3")).first()
    assert one.next_samples == one.samples and one.edited_text_sha256 == hashlib.sha256(b"same words" + b"same ").hexdigest()
    assert {r.doc_id: r.samples for r in cws.fingerprints(docs).collect()} == {r.doc_id: r.samples for r in found}


def test_next_text_across_buckets(spark):
    ids = [i * i for i in range(200)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for buckets in (1, 7, 64):
        got = {r.doc_id: r.next_text for r in cws.with_next(docs, buckets).where("not extra").collect()}
        assert got == {b: f"t{a}" for a, b in zip(ids, ids[1:])} | {0: f"t{ids[-1]}"}


def test_gamma_quantiles():
    import math
    grid = cws.gamma_quantiles()
    assert all(abs(1 - (1 + x) * math.exp(-x) - (i + 0.5) / cws.GRID) < 1e-9 for i, x in enumerate(grid))
