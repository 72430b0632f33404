import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowmatch.llm import decontam
from flowmatch.llm.queries import ORACLES, QUERIES
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


def brute(docs, items, window=10):
    """Per document: words, hit word places, item ids."""
    grams = []
    for i, t in items:
        w = decontam.words(t or "")
        n = min(window, len(w))
        if n:
            grams.append((i, n, {tuple(w[a:a + n]) for a in range(len(w) - n + 1)}))
    out = []
    for d, t in docs:
        w, hit, found = decontam.words(t or ""), set(), set()
        for i, n, g in grams:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in g:
                    hit.update(range(a, a + n))
                    if i is not None:
                        found.add(str(i))
        out.append((d, len(w), hit, sorted(found)))
    return out


def test_whole_table_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: (n, len(hit), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(hit)) for d, n, hit, f in brute(docs, items)}
    rows = QUERIES["op10_benchmark_decontamination"](spark, SF).collect()
    assert len(rows) == len(want) and all(tuple(r)[1:] == want[r.doc_id] for r in rows)
    assert sum(r.contaminated for r in rows) > 10


@pytest.mark.parametrize("window,gram,letters", [(10, 5, "abcd"), (6, 3, "abc"), (4, 4, "ab"), (10, 1, "abcd"), (3, 1, "abcdefg")])
def test_random_texts_against_brute_force(spark, window, gram, letters):
    rnd = random.Random(window * 7 + gram)
    text = lambda sizes: " ".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
    docs = [(i, text(range(60))) for i in range(120)] + [(500, None), (501, "")]
    items = [(i, text([0, 1, 2, 4, 5, 8, 9, 10, 11, 14, 20])) for i in range(9)] + [(99, None), (None, docs[3][1]), (3, docs[4][1]), (3, docs[4][1])]
    items = [x for x in items if len((x[1] or "").split()) != 1 or rnd.random() < 0.3]
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontam.contamination(a, b, window, gram).collect()}
    for d, n, hit, found in brute(docs, items, window):
        r = got.pop(d)
        places = {p for s in r.spans for p in range(s.start, s.end)}
        assert (r.n_words, places, r.n_hit, list(r["items"]), r.contaminated) == (n, hit, len(hit), found, bool(hit))
    assert not got
    clean = decontam.clean(a, b, window, gram)
    assert clean.dtypes == a.dtypes
    assert {r.doc_id for r in clean.collect()} == {d for d, _, hit, _ in brute(docs, items, window) if not hit}


def test_without_the_bitmap_nothing_changes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    run = decontam._fingerprint_rows
    monkeypatch.setattr(decontam, "_fingerprint_rows", lambda w, g, lengths, cells, whole: run(w, g, lengths, None, whole))
    assert {r.doc_id: r for r in decontam.contamination(docs, items).collect()} == a


def test_edge_tables(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (1, words), (None, words), (2, "long " * 90000 + words)], "doc_id long, text string")
    items = spark.createDataFrame([(7, words), (7, words), (8, "ÄB c!! ?? D")], "item_id long, text string")
    rows = decontam.contamination(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 40), (1, 40), (1, 40), (2, 40)] and all(r["items"] == ["7"] for r in rows)
    assert decontam.clean(docs, items).count() == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0
    none = decontam.contamination(docs, items.limit(0)).collect()
    assert len(none) == 4 and not any(r.contaminated for r in none)
    assert decontam.clean(docs, items.limit(0)).count() == 4


def test_whole_table_against_sql(spark):
    name = "op10_benchmark_decontamination"
    problems, *_ = compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF)
    assert not problems


def test_common_phrases_join_nothing(spark, monkeypatch):
    """Texts and items that share a phrase, but no window, are not joined at all."""
    rnd = random.Random(6)
    phrase = "the quick brown fox jumps over the lazy"
    text = lambda: " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(15)) + f" {phrase} " + " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(15))
    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text()) for i in range(600)], "item_id long, text string")
    kept, written = decontam.kept, []
    monkeypatch.setattr(decontam, "kept", lambda df: written.append(kept(df)) or written[-1])
    rows = decontam.contamination(docs, items).collect()
    assert len(rows) == 600 and not any(r.contaminated for r in rows)
    hits = written[-1]
    assert hits.columns == ["row", "class", "start", "end"] and hits.count() == 0
    # the phrase made long: every item's windows hit, one joined row a window of a text
    long = phrase + " dog and then some more"
    a = docs.withColumn("text", F.concat("text", F.lit(" " + long)))
    b = items.withColumn("text", F.concat("text", F.lit(" " + long)))
    rows = decontam.contamination(a, b).collect()
    assert all(len(r["items"]) == 600 for r in rows)
    extra = sum(r.n_hit - len(long.split()) for r in rows)  # a random word before the phrase that an item has, too
    assert 0 <= extra < 6 and written[-1].count() == 600 * (len(long.split()) - 9) + extra


def test_ids_of_any_type(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([("d-1", words), ("d-2", "other"), (None, words)], "doc_id string, text string")
    items = spark.createDataFrame([("a,b", words), ("x", words)], "item_id string, text string")
    rows = {r.doc_id: list(r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert rows == {"d-1": ["a,b", "x"], "d-2": [], None: ["a,b", "x"]}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == ["d-2"]
