"""Bucketed successor and carry-forward against plain windows, with a hot group."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmatch.operators.batch import carry_forward
from flowmatch.operators.sequence import with_successor


def _rows(seed=3, n=3000):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)  # group 0 holds a third of all rows
        ts = base + dt.timedelta(minutes=rnd.randint(0, 3 * 24 * 60))  # ties on ts happen
        out.append((g, ts, i, rnd.choice(["a", "b", None]), rnd.random()))
    return out


def test_successor_matches_window(spark):
    df = spark.createDataFrame(_rows(), "g int, ts timestamp, id long, v string, x double")
    got, heads = with_successor(df, ["g"], ["ts", "id"], ["id", "v"], bucket=F.date_trunc("hour", "ts"))
    w = Window.partitionBy("g").orderBy("ts", "id")
    want = df.select("id", F.lead("id").over(w).alias("n_id"), F.lead("v").over(w).alias("n_v"))
    a = {r.id: (r.next_id, r.next_v) for r in got.collect()}
    b = {r.id: (r.n_id, r.n_v) for r in want.collect()}
    assert a == b
    firsts = {r.g: r.id for r in heads.where("is_first_bucket").collect()}
    w1 = df.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    assert firsts == {r.g: r.id for r in w1.collect()}


def test_bucketed_carry_forward(spark):
    rows = [(g, i, (None if (i * 7 + g) % 3 else float(i))) for g in range(3) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o long, s double")
    got = carry_forward(df, ["g"], "o", ["s"], bucket=F.floor(F.col("o") / 16))
    plain = carry_forward(df, ["g"], "o", ["s"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_levels_of_buckets_change_nothing(spark):
    rows = [(g, i, (None if (i * 7 + g) % 11 else float(i))) for g in range(3) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "g int, o long, s double")
    plain = sorted(map(tuple, carry_forward(df, ["g"], "o", ["s"]).collect()))
    for levels in (0, 1, 3):
        got = carry_forward(df, ["g"], "o", ["s"], bucket=F.floor(F.col("o") / 4), fan=5, levels=levels)
        assert sorted(map(tuple, got.collect())) == plain
    a, ha = with_successor(df, ["g"], ["o"], ["o"], bucket=F.floor(F.col("o") / 4))
    b, hb = with_successor(df, ["g"], ["o"], ["o"], bucket=F.floor(F.col("o") / 4), coarser=lambda x: F.floor(x / 7))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(a) == key(b) and key(ha) == key(hb)


def test_successor_without_buckets(spark):
    df = spark.createDataFrame(_rows(), "g int, ts timestamp, id long, v string, x double")
    one, first = with_successor(df, ["g"], ["ts", "id"], ["id", "v"], bucket=None)
    two, heads = with_successor(df, ["g"], ["ts", "id"], ["id", "v"], bucket=F.date_trunc("hour", "ts"))
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)
    cols = ["g", "ts", "id", "v"]
    assert sorted(first.select(*cols).collect(), key=str) == sorted(heads.where("is_first_bucket").select(*cols).collect(), key=str)
