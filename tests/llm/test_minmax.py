import random

import numpy as np
import pytest

from flowmatch.llm import components, minmax
from flowmatch.llm.queries import QUERIES
from flowmatch.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def few_partitions(request):
    """Small tables: many short jobs, each with as few tasks as still shuffle."""
    if "spark" not in request.fixturenames:
        yield
        return
    conf = request.getfixturevalue("spark").conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", "3")
    yield
    conf.set("spark.sql.shuffle.partitions", before)


def words_of(text):
    return (text or "").encode("utf-8").lower().split()


def set_of(text, k):
    w = words_of(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    """Component of each row by comparing every pair of distinct sets."""
    sets = [set_of(t, k) for _, t in rows]
    distinct = list({s for s in sets if s})
    root = {s: i for i, s in enumerate(distinct)}
    parent = list(range(len(distinct)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(distinct):
        counts = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            at = top(root[s])
            least[at] = min(least.get(at, doc), doc)
    return [(doc, len(s), least.get(top(root[s])) if s else doc) for (doc, _), s in zip(rows, sets)]


def near_copies(n, seed=3):
    """One large group of near copies, its halves linked only by way of others, and documents that share half a text."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.randrange(0, 14)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(1000)}"
        out.append((1000 + i, " ".join(t)))
    half = [f"h{rnd.randrange(400)}" for _ in range(60)]
    out += [(5000 + i, " ".join(half + [f"y{rnd.randrange(10 ** 6)}" for _ in range(25)])) for i in range(60)]
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_every_document_as_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = QUERIES["op13_minmax_near_dedup"](spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert as_rows(found) == sorted(brute(rows, 2, 80), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_large_group_and_boilerplate_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 16)  # several blocks a bucket
    monkeypatch.setattr(minmax, "AT_FIRST", 1)  # several turns
    rows = near_copies(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(minmax.near_duplicates(docs, words=2)) == sorted(brute(rows, 2, 80), key=str)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (6, "one two"), (None, "ONE TWO"), (None, "alone here"),
            (7, "É one"), (8, "é one"), (9, "a b " * 50_000), (10, "a b"), (11, "b a")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, set_key int, node int")
    assert as_rows(minmax.near_duplicates(docs, words=2)) == sorted(brute(rows, 2, 80), key=str)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(docs, words=2).collect()}
    assert {(None, 1, 6, False), (None, 1, None, True), (5, 1, 4, False), (1, 0, 1, True)} <= got
    empty = minmax.near_duplicates(docs.where("doc_id = -1"), words=2)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_without_leader_rounds(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    monkeypatch.setattr(minmax, "LEADER_ROUNDS", 1)
    rows = near_copies(120, seed=8) + [(9000 + i, "one two three " * (i % 5 + 1)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(minmax.near_duplicates(docs, words=2)) == sorted(brute(rows, 2, 80), key=str)


def almost_alike(n):
    """Pairs just below the threshold, which bitmaps don't exclude: 88 of 112 shingles in common."""
    base = [f"w{i}" for i in range(101)]
    out = []
    for i in range(n):
        t = list(base)
        for k in range(3):
            t[2 + 2 * ((16 * k + i) % 48)] = f"x{i}-{k}"
        out.append((1000 + i, " ".join(t)))
    return out


def test_pairs_that_bitmaps_allow_take_no_further_turns(spark, monkeypatch):
    turns, between = [], minmax._between_components
    monkeypatch.setattr(minmax, "_between_components", lambda *args: turns.append(1) or between(*args))
    rows = almost_alike(60) + near_copies(60, seed=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(minmax.near_duplicates(docs, words=2)) == sorted(brute(rows, 2, 80), key=str)
    assert len(turns) == 1


def test_more_forests_where_pairs_are_not_confirmed(spark, monkeypatch):
    calls, confirmed = [], minmax._confirmed

    def some(*args):
        calls.append(1)
        found = confirmed(*args)
        return found.where("pmod(u + v, 3) > 0") if len(calls) == 2 else found  # of the first blocks' pairs

    monkeypatch.setattr(minmax, "_confirmed", some)
    rows = near_copies(120, seed=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(minmax.near_duplicates(docs, words=2)) == sorted(brute(rows, 2, 80), key=str)
    assert len(calls) > 2


@pytest.mark.parametrize("links", [5, 1 << 18])
def test_links_contracted_in_one_task_or_many(spark, monkeypatch, links):
    monkeypatch.setattr(components, "LINKS", links)
    pairs = [(i, i + 1) for i in range(40)] + [(103, 101), (102, 103), (101, 103), (7, 7), (None, 3), (200, None)]
    got = components.contracted(spark.createDataFrame(pairs, "u long, v long").repartition(4))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(41)] + [(i, 101) for i in (101, 102, 103)]
    assert components.contracted(spark.createDataFrame([], "u long, v long")).collect() == []


def test_spanning_pairs_withhold_none_in_the_end():
    rnd = np.random.default_rng(4)
    pool = np.unique(rnd.integers(0, 1 << 63, 300, np.uint64))
    sets = [pool[rnd.random(len(pool)) < 0.93] for _ in range(30)]
    n, root, side = np.array([len(s) for s in sets]), np.arange(30) // 2, np.full(30, 2)
    alike = {(i, j) for j in range(30) for i in range(j) if root[i] != root[j]
             and 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - both)}
    short = [s.astype(np.uint32) for s in sets]
    a, b, withheld = minmax.spanning_pairs(n, root, short, side, 80, 1)
    assert len(a) == 14 and withheld
    a, b, withheld = minmax.spanning_pairs(n, root, short, side, 80, 1000)
    assert not withheld and len(alike) == len(a) == 420 and {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == alike


def test_bitmaps_never_exclude_a_link():
    rnd = np.random.default_rng(11)
    for _ in range(300):
        n = int(rnd.integers(1, 400))
        pool = rnd.integers(0, 1 << 63, n + n // 3 + 1, np.uint64)
        sets = [np.unique(pool[rnd.random(len(pool)) < rnd.random()]) for _ in range(6)]
        sets = [s for s in sets if len(s)]
        sizes, roots = np.array([len(s) for s in sets]), np.arange(len(sets))
        a, b, most = minmax.possible_pairs(sizes, roots, [minmax.bitmap(s) for s in sets], np.full(len(sets), 2), 80)
        got = {(min(i, j), max(i, j)): m for i, j, m in zip(a.tolist(), b.tolist(), most)}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                alike = both / (len(sets[i]) + len(sets[j]) - both)
                assert alike < 0.8 or got[j, i] >= alike


@pytest.mark.parametrize("size,other", [(5, 4), (10, 8), (300, 240), (3000, 2400)])
def test_agreement_is_the_similarity(size, other):
    """Minima and maxima agree as often as the sets are alike, and a pair at the threshold shares a band."""
    rnd = np.random.default_rng(size)
    rate, shared = [], 0
    for _ in range(60):
        whole = rnd.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = minmax.min_max([np.unique(whole), np.unique(whole[:other])])
        rate.append((a == b).mean())
        x, y = minmax.bands(np.stack([a, b]))
        shared += bool((x == y).any())
    assert abs(np.mean(rate) - other / size) < 0.03
    assert shared == 60
