"""Whole model files as a stream: each model scored once, batches replayed."""

import gzip
import os
import tempfile

from pyspark.sql import functions as F

from flowmatch.operators import labels as L
from flowmatch.operators import parse as P
from flowmatch.operators import score as S
from flowmatch.session import cut_lineage
from flowmatch.sources import models as M
from flowmatch.streaming import incremental as X
from test_parse import EXPECTED_AP6, ONLY_SUBPROCESS

PATTERN = r"([^/]+)/([^/]+)/([0-9]+)\.txt$"
KEYS = {"provider": "string", "pattern": "string", "ordinal": "int"}


def put(folder, name, text):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_files_in_batches_equal_the_batch_result(spark):
    d = tempfile.mkdtemp(prefix="fm-stream-")
    models = spark.createDataFrame([("expected/AP6", EXPECTED_AP6)], "model_id string, text string")
    p = P.parse_models(models)
    as_key = F.struct(F.lit("expected").alias("provider"), F.lit("AP6").alias("pattern"), F.lit(-1).alias("ordinal"))
    counts = cut_lineage(S.label_counts(L.model_labels(p["elements"], L.parsed_flows(p["flows"]))).withColumn("model_id", as_key))
    slots = [(prov, "AP6", i) for prov in ("gpt", "gemini") for i in range(6)]
    assign = spark.createDataFrame(slots, "provider string, pattern string, ordinal int").withColumn("m1", as_key)

    def run():
        X.start_files(spark, d + "/in", PATTERN, KEYS, assign, counts, d + "/out", d + "/ckpt").awaitTermination()
        return spark.read.parquet(d + "/out")

    put(d, "in/day-1/gpt/AP6/0.txt", EXPECTED_AP6)
    put(d, "in/day-1/gpt/AP6/1.txt", ONLY_SUBPROCESS)
    put(d, "in/day-1/gpt/AP6/notes.txt", "no model")
    put(d, "in/day-1/gpt/AP6/2.csv", EXPECTED_AP6)
    first = {(r.provider, r.ordinal): r.overall for r in run().collect()}
    assert {k: round(v, 6) for k, v in first.items()} == {("gpt", 0): 1.0, ("gpt", 1): 0.785714}
    # the second delivery brings a model again, with another text, and one model twice
    put(d, "in/day-2/gpt/AP6/0.txt", ONLY_SUBPROCESS)
    put(d, "in/day-2/a/gemini/AP6/3.txt", EXPECTED_AP6.replace("0:", "10:").replace("8:", "18:"))
    put(d, "in/day-2/b/gemini/AP6/3.txt", ONLY_SUBPROCESS)
    put(d, "in/day-2/gemini/AP6/4.txt", "flowchart LR\n1:task:(task A)\n")
    rows = [(r.provider, r.ordinal, round(r.overall, 6), r.batch_id) for r in run().collect()]
    assert sorted(rows) == [("gemini", 3, 1.0, 1), ("gemini", 4, 0.0, 1), ("gpt", 0, 1.0, 0), ("gpt", 1, 0.785714, 0)]
    assert sorted(run().select("provider", "ordinal").collect()) == sorted((r[0], r[1]) for r in rows)  # nothing new
    # the batch result over one text of each model
    texts = [("gpt", 0, EXPECTED_AP6), ("gpt", 1, ONLY_SUBPROCESS), ("gemini", 3, EXPECTED_AP6), ("gemini", 4, "flowchart LR\n1:task:(task A)\n")]
    batch = spark.createDataFrame([(p, "AP6", i, t) for p, i, t in texts], "provider string, pattern string, ordinal int, text string")
    whole, _ = X.score_batch(batch, list(KEYS), assign, counts)
    assert sorted((r.provider, r.ordinal, round(r.overall, 6)) for r in whole.collect()) == sorted(r[:3] for r in rows)


def test_small_files_are_read_many_in_a_task(spark, monkeypatch):
    """The stream starts with settings for small files; the session has its own again after."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before, seen = [spark.conf.get(n) for n in names], []
    monkeypatch.setattr(X, "_started", lambda *_: seen.extend(spark.conf.get(n) for n in names))
    X.start_files(spark, tempfile.mkdtemp(prefix="fm-stream-"), PATTERN, KEYS, None, None, "", "")
    number = lambda x: int(x.removesuffix("b"))
    assert number(seen[0]) <= 1 << 16 < number(before[0]) and int(seen[1]) <= 64 < int(before[1])
    assert [spark.conf.get(n) for n in names] == before


def test_small_file_settings_last_beyond_the_start(spark, monkeypatch):
    """The file source asks its session whenever a batch begins, when the settings at the start are gone."""
    seen = []
    monkeypatch.setattr(X, "_started", lambda src, *_: seen.append(src))
    X.start_files(spark, tempfile.mkdtemp(prefix="fm-stream-"), PATTERN, KEYS, None, None, "", "")
    conf = seen[0].sparkSession.conf
    assert int(conf.get("spark.sql.files.openCostInBytes").removesuffix("b")) <= 1 << 16
    assert int(conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 64
    assert conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")


def test_texts_of_a_stream_are_the_bytes_of_the_files(spark, monkeypatch):
    """Line ends, a byte order mark, an empty and a compressed file, as the reader of whole texts gives them."""
    d = tempfile.mkdtemp(prefix="fm-stream-")
    texts = {"a/x y.txt": "1\r\n2\n", "a/b/ä.txt": "\ufeffÄ\n\n", "c.txt": ""}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(os.path.join(d, "in", name)), exist_ok=True)
        with open(os.path.join(d, "in", name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    with gzip.open(os.path.join(d, "in", "z.txt.gz"), "wt") as f:
        f.write("packed")
    for glob in ("*.txt", "*.gz"):
        out = f"{d}/out-{glob[2:]}"
        q = X._whole_files(spark, d + "/in", glob).writeStream.format("parquet").option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start(out)
        q.awaitTermination()
        want = M.read_texts(spark, d + "/in", glob)
        assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect()) != []


def test_text_files_are_written_whole(spark):
    d = tempfile.mkdtemp(prefix="fm-texts-")
    rows = [(f"user={i % 3}/week={i}/model.txt", f"line {i}\nÄ") for i in range(20)] + [(None, "no key"), ("top.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(4)
    assert M.write_texts(df, d) == M.write_texts(df, "file://" + d) == 21  # written again: replaced
    found = {os.path.relpath(os.path.join(at, f), d): open(os.path.join(at, f), encoding="utf-8").read() for at, _, names in os.walk(d) for f in names}
    assert found == {p: (t or "") + "\n" for p, t in rows if p}
    assert M.write_texts(df.limit(0), d) == 0
