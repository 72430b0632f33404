"""Sources and sinks round trips: whole-file text, NA handling, partitions."""

import os
import tempfile

from pyspark.sql import functions as F

from flowmatch.operators import generate as G
from flowmatch.operators import reshape as R
from flowmatch.sources import models as SM


def test_wholetext_and_layout(spark):
    d = tempfile.mkdtemp(prefix="fm-src-")
    for prov, pat, n, txt in [("gpt", "AP6", 0, "flowchart LR\na\nb\n"), ("gemini", "AP18", 12, "x\ny")]:
        os.makedirs(os.path.join(d, prov, pat))
        with open(os.path.join(d, prov, pat, f"{n}.txt"), "w") as f:
            f.write(txt)
    rows = sorted((r.provider, r.pattern, r.ordinal, r.text) for r in SM.read_candidates(spark, d, "AAO").collect())
    assert rows == [("gemini", "AP18", 12, "x\ny"), ("gpt", "AP6", 0, "flowchart LR\na\nb\n")]


def test_csv_na_and_partitioned_sink(spark):
    d = tempfile.mkdtemp(prefix="fm-csv-")
    with open(os.path.join(d, "gpt-AP6-evaluation.csv"), "w") as f:
        f.write("idx,mapping,epap,user,meaning\n0,True,True,u,NA\n1,True,False,v,False\n2,False,False,w,\n")
    df = SM.read_result_csv(spark, d)
    m = [r.meaning for r in df.orderBy("idx").collect()]
    assert m == [None, "False", None]
    out = os.path.join(d, "out")
    SM.write_partitioned(df.withColumn("provider", F.lit("gpt")).withColumn("pattern", F.lit("AP6")), out)
    assert os.path.isdir(os.path.join(out, "provider=gpt", "pattern=AP6"))


def test_batch_generate_retry_and_errors(spark):
    df = spark.createDataFrame([("aaaaaaa",), ("bb",), ("bb",), (None,)], "p string")

    def client():
        def call(prompt, system):
            if len(prompt) % 7 == 0:
                raise RuntimeError("boom")
            return prompt.upper()
        return call
    out = {r.p: r for r in G.batch_generate(df, "p", client, partitions=2, min_interval=0.0,
                                             retry_wait=0.0).collect()}
    assert out["bb"].reply == "BB" and out["bb"].attempts == 1 and out["bb"].error is None
    assert out["aaaaaaa"].reply is None and out["aaaaaaa"].attempts == 3 and "boom" in out["aaaaaaa"].error
    assert out[None].reply is None


def test_provider_routing():
    assert R.check_provider("GPT") == "gpt"
    try:
        R.check_provider("other")
    except ValueError:
        pass
    else:
        raise AssertionError("unknown provider accepted")


def test_survey_slice_and_summary_sink(spark):
    cols = [f"c{i}" for i in range(6)] + [f"AP{i}" for i in range(18)] + ["extra"]
    wide = spark.createDataFrame([tuple(range(len(cols)))], ", ".join(f"{c} int" for c in cols))
    assert SM.survey_patterns(wide).columns == [f"AP{i}" for i in range(18)]
    d = tempfile.mkdtemp(prefix="fm-sum-")
    summ = spark.createDataFrame([("gpt", "AP6", "True,True,True,True", 3)], "provider string, pattern string, outcome string, n long")
    SM.write_summary(summ, os.path.join(d, "s"))
    back = spark.read.option("header", True).csv(os.path.join(d, "s")).collect()
    assert [tuple(r) for r in back] == [("gpt", "AP6", "True,True,True,True", "3")]


def test_csv_round_trip_of_free_text(spark):
    d = tempfile.mkdtemp(prefix="fm-csv-")
    rows = [(0, 'a "quoted" word', "two\nlines, one cell"), (1, "x", None), (2, "False", 'end"')]
    df = spark.createDataFrame(rows, "idx int, user string, meaning string")
    SM.write_partitioned(df.withColumns({"provider": F.lit("gpt"), "pattern": F.lit("AP6")}), d + "/out", fmt="csv")
    back = SM.read_result_csv(spark, d + "/out/provider=gpt/pattern=AP6").orderBy("idx").collect()
    assert [(int(r.idx), r.user, r.meaning) for r in back] == rows


def test_csv_pattern_and_index(spark):
    d = tempfile.mkdtemp(prefix="fm-csv-")
    for name in ("gpt-AP8.1-evaluation.csv", "gpt-AP9.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write(',meaning\n0,"one\n""two"""\n')
    rows = SM.read_result_csv(spark, d).orderBy("pattern").collect()
    assert [(r.idx, r.meaning, r.pattern) for r in rows] == [("0", 'one\n"two"', "AP8.1"), ("0", 'one\n"two"', "AP9")]


def write(folder, name, text):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_csv_files_with_unlike_headers(spark):
    d = tempfile.mkdtemp(prefix="fm-csv-")
    write(d, "a/x.csv", "ids,similarity\n7,0.25\n8,NA\n")
    write(d, "a/b/y.csv", "similarity,ids\n0.5,9\n")
    write(d, "z-AP3-e.csv", ',"a ""b"", c",ids\n0,"two\nlines",11\nids,similarity,x\n')
    write(d, "one.csv", "ids\n12\n")
    write(d, "empty.csv", "")
    write(d, "only.csv", "similarity,ids\n")
    df = SM.read_result_csv(spark, d)
    assert set(df.columns) == {"ids", "similarity", "idx", 'a "b", c', "pattern", "_file"}
    got = sorted((r["ids"], r["similarity"], r["idx"], r['a "b", c'], r["pattern"], r["_file"]) for r in df.collect())
    assert got == [("11", None, "0", "two\nlines", "AP3", "z-AP3-e.csv"), ("12", None, None, None, None, "one.csv"), ("7", "0.25", None, None, None, "x.csv"),
                   ("8", None, None, None, None, "x.csv"), ("9", "0.5", None, None, None, "y.csv"), ("x", None, "ids", "similarity", "AP3", "z-AP3-e.csv")]
    typed = SM.read_result_csv(spark, d, schema="ids string, similarity double, missing int")
    assert sorted((r.ids, r.similarity, r.missing) for r in typed.where("similarity is not null").collect()) == [("7", 0.25, None), ("9", 0.5, None)]


def test_csv_of_a_partitioned_sink(spark):
    d = tempfile.mkdtemp(prefix="fm-csv-")
    rows = [(i, "gpt" if i % 2 else "gemini", f"AP{i % 3}", f"m {i}") for i in range(12)]
    SM.write_partitioned(spark.createDataFrame(rows, "idx int, provider string, pattern string, meaning string"), d + "/out", fmt="csv")
    got = SM.read_result_csv(spark, d + "/out", schema="idx int, meaning string").collect()
    assert sorted((r.idx, r.pattern, r.meaning) for r in got) == [(i, p, m) for i, _, p, m in rows]


def test_rows_of_many_survey_files_are_numbered_in_order(spark):
    d = tempfile.mkdtemp(prefix="fm-survey-")
    expected = []
    for k in range(7):
        rows = [f"{k}.{i}" for i in range(k * 13 % 10)]
        expected += rows
        write(d, f"sheet-{k}.csv", "a,b\n" + "".join(f"{r},x\n" for r in rows))
    df = SM.read_survey(spark, d, 0, 2)
    assert "Window" not in df._jdf.queryExecution().toString()
    got = sorted((r.ordinal, r.a) for r in df.collect())
    assert got == list(enumerate(expected))
    big = tempfile.mkdtemp(prefix="fm-survey-") + "/s.parquet"
    spark.range(5000, numPartitions=6).selectExpr("id a", "id b").write.option("parquet.block.size", 4096).parquet(big)
    got = SM.read_survey(spark, big, 0, 2).collect()
    assert sorted(r.ordinal for r in got) == list(range(5000)) and all(r.ordinal == r.a for r in got)


def test_repeated_cells_get_rows_of_their_own(spark):
    rows = [(1, "A", "x", 3), (1, "A", "y", 2), (1, "B", "z", 1), (2, "A", None, 1), (1, "A", "w", 9)]
    long = spark.createDataFrame(rows, "id int, pattern string, text string, turn int")
    wide = R.pivot_results(long, "id", "pattern", "text", order="turn")
    assert wide.columns == ["id", "occurrence", "A", "B"]
    assert sorted(map(tuple, wide.collect())) == [(1, 0, "y", "z"), (1, 1, "x", None), (1, 2, "w", None), (2, 0, None, None)]
    back = R.unpivot_wordings(wide, ["id"], ["A", "B"])
    assert sorted((r.id, r.pattern, r.text) for r in back.collect()) == [(1, "A", "w"), (1, "A", "x"), (1, "A", "y"), (1, "B", "z")]


def test_survey_to_prompt(spark):
    d = tempfile.mkdtemp(prefix="fm-survey-")
    cols = [f"c{i}" for i in range(6)] + [p for p, _, _ in R.RULEBASE]
    with open(os.path.join(d, "survey.csv"), "w") as f:
        f.write(",".join(cols) + "\n")
        for r in range(3):
            f.write(",".join([f"m{r}"] * 6 + [f'"change {r}, please"' if (i + r) % 2 else "" for i in range(18)]) + "\n")
    wide = SM.read_survey(spark, os.path.join(d, "survey.csv"))
    assert wide.columns == ["ordinal"] + cols[6:]
    long = R.unpivot_wordings(wide, ["ordinal"], cols[6:])
    assert sorted({r.ordinal for r in long.collect()}) == [0, 1, 2] and long.count() == 27
    models = spark.createDataFrame([("ipm-1", "flowchart LR\nx"), ("ipm-7", "flowchart LR\ny")], "name string, text string")
    out = R.input_texts(R.input_lookup(long), models)
    prompts = {(r.ordinal, r.pattern): r.p for r in out.withColumn("p", R.change_prompt(F.col("model_text"), F.col("text"))).collect()}
    assert prompts[1, "AP1"] == "Consider following process model: flowchart LR\nx\n Apply these changes to the model: change 1, please"
    seven = [p for (_, pattern), p in prompts.items() if pattern == "AP7"]
    assert seven and all(p.startswith("Consider following process model: flowchart LR\ny") for p in seven)
    assert all(p is None for (_, pattern), p in prompts.items() if pattern == "AP15")


def test_replies_are_kept_and_not_asked_again(spark):
    d = tempfile.mkdtemp(prefix="fm-replies-")
    calls = os.path.join(d, "calls")
    os.makedirs(calls)

    def client():
        import uuid

        def call(prompt, system):
            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            if prompt == "bad" and len(os.listdir(calls)) < 12:
                raise RuntimeError("busy")
            return prompt + "!"
        return call
    df = spark.createDataFrame([(f"p{i % 10}",) for i in range(30)] + [("bad",), (None,)], "p string")
    kw = {"partitions": 1, "min_interval": 0.0, "retries": 0, "retry_wait": 0.0}
    out = G.generate_to_table(df, "p", client, d + "/replies", **kw)
    for _ in range(2):  # actions read the table
        got = {r.p: r.reply for r in out.collect()}
    assert len(got) == 12 and got["p3"] == "p3!" and got[None] is None
    n = len(os.listdir(calls))
    assert n == 11
    again = {r.p: r.reply for r in G.generate_to_table(df, "p", client, d + "/replies", **kw).collect()}
    assert len(os.listdir(calls)) == n + (got["bad"] is None) and again["bad"] == "bad!"


def test_pacing_and_chunks(spark):
    import time

    def client():
        return lambda prompt, system: prompt
    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "p string")
    t = time.time()
    out = G.batch_generate(df, "p", client, partitions=1, min_interval=0.05, retry_wait=0.0).collect()
    assert len(out) == 20 and all(r.reply == r.p for r in out) and time.time() - t >= 0.05 * 19


def test_rate_holds_over_all_tasks(spark):
    import time
    d = tempfile.mkdtemp(prefix="fm-rate-")

    def client():
        def call(prompt, system):
            import uuid
            with open(os.path.join(d, uuid.uuid4().hex), "w") as f:
                f.write(repr(time.time()))
            if prompt == "p3":
                raise RuntimeError("busy")  # its repeats count as calls, too
            return prompt
        return call
    df = spark.createDataFrame([(f"p{i}",) for i in range(24)], "p string")
    out = G.batch_generate(df, "p", client, partitions=8, min_interval=0.2, retry_wait=0.0).collect()
    assert sum(r.reply == r.p for r in out) == 23
    at = sorted(float(open(os.path.join(d, f)).read()) for f in os.listdir(d))
    assert len(at) == 26
    for k in range(len(at)):  # calls in any second
        assert sum(at[k] <= t < at[k] + 1.0 for t in at) <= 6


def test_a_killed_task_loses_no_reply(spark):
    d = tempfile.mkdtemp(prefix="fm-replies-")
    calls = os.path.join(d, "calls")
    os.makedirs(calls)

    def client():
        import uuid

        def call(prompt, system):
            if prompt == "p7" and not os.path.exists(os.path.join(d, "killed")):
                open(os.path.join(d, "killed"), "w").close()
                os._exit(1)
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            return prompt + "!"
        return call
    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "p string")
    kw = {"partitions": 2, "min_interval": 0.0, "retry_wait": 0.0}
    try:  # a local session gives a task one attempt
        G.generate_to_table(df, "p", client, d + "/replies", **kw)
    except Exception:
        pass
    else:
        raise AssertionError("the worker was killed")
    assert 0 < len(os.listdir(calls)) < 20
    out = G.generate_to_table(df, "p", client, "file://" + d + "/replies", **kw)
    assert {r.p: r.reply for r in out.collect()} == {f"p{i}": f"p{i}!" for i in range(20)}
    asked = [open(os.path.join(calls, f)).read() for f in os.listdir(calls)]
    assert sorted(asked) == sorted(f"p{i}" for i in range(20))  # none twice


def test_another_attempt_of_a_task_asks_the_rest(monkeypatch):
    """The task function itself, run again as Spark does after a lost executor."""
    import pandas as pd
    import pytest
    d = tempfile.mkdtemp(prefix="fm-replies-")
    asked = []

    def make():
        def call(prompt, system):
            if prompt == "c" and "c" not in asked:
                asked.append("c")
                raise SystemExit  # the end of the worker
            asked.append(prompt)
            return prompt.upper()
        return call
    prompts = [pd.DataFrame({"prompt": ["a", "b"]}), pd.DataFrame({"prompt": ["c", "d"]})]
    with pytest.raises(SystemExit):
        list(G._run(make, "", 0.0, 0, 0.0, 1, d)(iter(prompts)))
    assert sorted(G.ReplyLog(d, 0).answered) == ["a", "b"] and G.ReplyLog(d, 1).answered == set()
    got = pd.concat(G._run(make, "", 0.0, 0, 0.0, 1, d)(iter(prompts)))
    assert list(got["prompt"]) == ["c", "d"] and asked == ["a", "b", "c", "c", "d"]
    assert len(os.listdir(d)) == 1 and G.ReplyLog(d, 0).answered == {"a", "b", "c", "d"}


def test_prompts_go_to_their_provider(spark):
    def make(name):
        return lambda: lambda prompt, system: f"{name}:{prompt}"
    df = spark.createDataFrame([("a", "GPT"), ("b", "mistral"), ("c", "other"), ("d", None)], "p string, provider string")
    out = G.generate_by_provider(df, "p", "provider", {"gpt": make("g"), "mistral": make("m")}, partitions=1, min_interval=0.0)
    got = {r.p: (r.reply, r.error) for r in out.collect()}
    assert got == {"a": ("g:a", None), "b": ("m:b", None), "c": (None, "unknown provider"), "d": (None, "unknown provider")}


def test_small_corpus_end_to_end(spark):
    """Hand-written files in the corpus layout, from text to dense scores."""
    from flowmatch.operators import batch as B
    from test_parse import EXPECTED_AP6, ONLY_SUBPROCESS
    d = tempfile.mkdtemp(prefix="fm-corpus-")
    texts = {0: EXPECTED_AP6, 1: ONLY_SUBPROCESS, 2: "flowchart LR\n1:task:(task A)\n",
             4: "```\n" + EXPECTED_AP6.replace("0:", "10:").replace("8:", "18:") + "```\n"}
    for name, text in [("EAO/AP6.txt", EXPECTED_AP6), *[(f"AAO/gpt/AP6/{i}.txt", t) for i, t in texts.items()]]:
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    cands, expected = SM.read_candidates(spark, d + "/AAO", "AAO"), SM.read_named(spark, d + "/EAO")
    sc = B.score_against_expected(cands, expected)
    got = {r.ordinal: (round(r.similarity, 6), r.is_exact) for r in sc.collect()}
    assert got[0] == got[4] == (1.0, True) and got[1][0] == 0.785714 and got[2] == (0.0, False)
    dense = B.dense_ordinals(sc, ["provider", "pattern"], n=6).agg(F.avg("similarity"), F.count("*")).first()
    assert round(dense[0], 6) == round((1 + 1 + 0.785714 + 0) / 6, 6) and dense[1] == 6
