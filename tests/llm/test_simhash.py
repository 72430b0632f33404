import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowmatch.llm import simhash
from flowmatch.llm.components import components


def brute_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, max_bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def fingerprints_with_groups(n, seed):
    rnd, out = random.Random(seed), []
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 1, 4, 40])):  # chains of flips: groups of copies
            out.append(base)
            for _ in range(rnd.randrange(0, 5)):
                base ^= 1 << rnd.randrange(64)
    return list(dict.fromkeys(out))[:n]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ("", "  \n", "one", "A b", "a b c d", "the The THE the the the", "é ü ñ o ä x y", "w " * 70000):
        assert simhash.fingerprint(text, 4) == (brute_fingerprint(text, 4) if len(text) < 1000 else simhash.fingerprint("w w w w", 4))


@pytest.mark.parametrize("trees,target,rows", [(3, 40, 10**6), (3, 40, 30), (2, 60, 50), (1, 100, 10**6), (5, 30, 10**6)])
def test_links_span_exactly_the_brute_force_groups(spark, trees, target, rows):
    fps = fingerprints_with_groups(700, trees)
    signed = [simhash.signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.near_links(df, 4, trees, rows, target)).collect()}
    groups = brute_groups(fps, 4)
    by_root, by_brute = {}, {}
    for x, g in zip(signed, groups):
        by_root.setdefault(found.get(x, x), set()).add(x)
        by_brute.setdefault(g, set()).add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))
    assert max(map(len, by_brute.values())) > 20


def test_large_group_gives_a_forest_not_all_pairs(spark):
    rnd, base = random.Random(5), 0x0123456789ABCDEF
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    links = simhash.near_links(df, 4)
    assert links.count() <= 30 * len(fps)  # leaves times rows, far below the two million pairs
    assert components(links).select("root").distinct().count() == 1
    assert rnd


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(5, 5), (100, 90), (90, 100), (90, 95), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (7, " \n", "x"), (None, "a b c d e", "x"), (9, "a b c d e", "y"), (9, "a b c d e", "y"), (11, "long " * 90000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 9), (3, 3), (5, 3), (7, 3), (9, 9), (9, 9), (11, 11)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9, 11]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert docs.select(F.max("doc_id")).first()[0] == 11


def test_whole_table_against_brute_force(spark):
    from flowmatch.llm.queries import QUERIES
    rows = QUERIES["op1_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[d], 4) for d in ids]
    groups = brute_groups(fps, 4)
    want = {d: (f"{f:016x}", ids[g]) for d, f, g in zip(ids, fps, groups)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want
    assert np.array(fps, np.uint64).any()
