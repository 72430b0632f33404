import random
import zlib

from pyspark.sql import functions as F

from flowmatch.llm import sharding
from flowmatch.llm.queries import QUERIES


def held(rows, n=16):
    """The law of the rows: shard bytes, gapless slots."""
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert all(0 <= s < n for s in shards)
    return [sum(r.size for r in shards.get(s, [])) for s in range(n)]


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op9_histogram_sort_shards"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    sizes = held(rows)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_hot_group_is_cut_by_doc_id(spark):
    rnd = random.Random(1)
    rows = [(i, "copy " * 20) for i in range(2000)] + [(i, "w" * rnd.randrange(1, 200)) for i in range(2000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = held(sharding.shards(docs).collect())
    total = sum(sizes)
    assert all(abs(s - total / 16) <= 0.002 * total / 16 + 210 for s in sizes)


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i // 4} " + "x" * 300) for i in range(8000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.02).collect()
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert max(map(len, where.values())) == 1


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "x", 7), (None, "x", 7), (3, "y" * 200000, 8), (3, "same", 9), (3, "same", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").withColumns({c: F.col("rank") for c in ("_id", "_Hash", "_size", "_piece", "__rank")})
    found = sharding.shards(docs)
    assert found.columns == docs.columns + ["size", "shard", "slot"]
    got = found.collect()
    assert all(r._id == r._Hash == r._size == r._piece == r["__rank"] == r.rank for r in got)
    assert len(got) == len(rows) and sorted(r.rank for r in got) == sorted(r[2] for r in rows)
    held(got)
    assert sharding.shards(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.shards(docs, n_shards=1).collect()} == {0}


def test_many_splitters_in_turns(spark, monkeypatch):
    """More open intervals than a round counts, and few cells for each."""
    monkeypatch.setattr(sharding, "INTERVALS", 8)
    monkeypatch.setattr(sharding, "CELLS", 32)
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "z" * rnd.randrange(1, 90)) for i in range(3000)], "doc_id long, text string")
    sizes = held(sharding.shards(docs, pieces=6).collect())
    total = sum(sizes)
    assert all(abs(s - total / 16) <= 0.004 * total / 16 + 200 for s in sizes)
