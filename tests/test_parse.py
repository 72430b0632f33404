"""Parser edge cases on hand-made model texts and the worked scoring example."""

import pytest
from pyspark.sql import functions as F

from flowmatch.operators import batch as B
from flowmatch.operators import parse as P
from flowmatch.operators import validate as V

EXPECTED_AP6 = ("flowchart LR\n0:startevent:((startevent))-->1:task:(task A)\n"
                "1:task:-->7:subprocess:(subprocess F)\n7:subprocess:-->8:endevent:((endevent))\n")
ONLY_SUBPROCESS = "flowchart LR\n1:task:(task A)-->7:subprocess:(subprocess F)\n"


def _models(spark, texts):
    return spark.createDataFrame(list(texts.items()), "model_id string, text string")


def test_edge_cases(spark):
    texts = {
        "fence": "```\nflowchart LR\n0:startevent:((s))-->1:task:(A)\n```",
        "empty_type": "flowchart LR\n0:task:(A)-->7:\n7:-->1:task:(B)",
        "bare": "flowchart LR\n0:startevent:((s))-->1:task:(A)\n0-->1",
        "no_arrow": "flowchart LR\n0:startevent:((s))",
        "edge_label": "flowchart LR\n2:exclusivegateway:{x}-->|true|3:task:(B)",
        "chain": "graph LR\n1:task:(a)-->2:task:(b)-->3:task:(c)",
        "bad_event": "flowchart LR\n0:midevent:((m))-->1:task:(A)",
        "colon_label": "flowchart LR\n2:exclusivegateway:{x}-->|a:b|3:task:(B)",
        "relabel": "flowchart LR\n1:task:(first)-->2:task:(x)\n1:task:(second)-->2:task:",
    }
    p = P.parse_models(_models(spark, texts))
    nodes = {(r.model_id, r.kind, r.node_id): r.value for r in p["nodes"].collect()}
    flows = {}
    for r in p["flows"].collect():
        flows.setdefault(r.model_id, []).append((r.id, r.sourceRef, r.targetRef))
    flags = {r.model_id: r.scorable for r in p["flags"].collect()}
    assert flows["fence"] == [("sf0", "0", "1")]
    assert ("empty_type", "task", "7") not in nodes and flows["empty_type"][0] == ("sf0", "0", "7")
    assert flows["bare"] == [("sf0", "0", "1")]
    assert flows["no_arrow"] == [("sf0", "0", None)] and flags["no_arrow"] is False
    assert flows["edge_label"] == [("sf0", "2", "3")]
    assert ("chain", "task", "3") in nodes and flows["chain"] == [("sf0", "1", "2")]
    assert flags["bad_event"] is False
    assert flags["colon_label"] is False
    assert nodes[("relabel", "task", "1")] == "second"
    assert flags["chain"] and flags["fence"] and flags["relabel"]


def test_worked_example(spark):
    exp = _models(spark, {"expected/AP6": EXPECTED_AP6}).withColumn("pattern", F.lit("AP6"))
    cand = _models(spark, {"c": ONLY_SUBPROCESS}).withColumn("pattern", F.lit("AP6"))
    r = B.score_against_expected(cand, exp).collect()[0]
    assert r.similarity == pytest.approx(0.785714, abs=1e-6)
    assert r.is_exact is False
    self_score = B.score_against_expected(
        _models(spark, {"c": EXPECTED_AP6}).withColumn("pattern", F.lit("AP6")), exp).collect()[0]
    assert self_score.similarity == 1.0 and self_score.is_exact


def test_alternative_score(spark):
    from flowmatch.operators import labels as L
    from flowmatch.operators import score as S
    m = _models(spark, {"e": EXPECTED_AP6, "c": ONLY_SUBPROCESS})
    p = P.parse_models(m)
    counts = S.label_counts(L.model_labels(p["elements"], L.parsed_flows(p["flows"])))
    pairs = spark.createDataFrame([("e", "c")], "m1 string, m2 string")
    r = S.score_pairs(pairs, counts, alternative=True).collect()[0]
    assert r.overall == pytest.approx(0.75, abs=1e-6)


def test_text_roundtrip(spark):
    text = "flowchart LR\n0:startevent:((startevent))-->1:task:(A)\n1:task:-->2:exclusivegateway:{x}\n2:exclusivegateway:-->3:endevent:((endevent))"
    p = P.parse_models(_models(spark, {"m": text}))
    out = P.model_text(p["elements"], p["flows"]).collect()[0]
    assert out.complete
    p2 = P.parse_models(_models(spark, {"m": out.text}))
    a = sorted((r.kind, r.node_id) for r in p["nodes"].collect())
    b = sorted((r.kind, r.node_id) for r in p2["nodes"].collect())
    assert a == b
    assert [(r.sourceRef, r.targetRef) for r in p["flows"].orderBy("edge_no").collect()] == \
        [(r.sourceRef, r.targetRef) for r in p2["flows"].orderBy("edge_no").collect()]


def test_validation_rules(spark):
    text = ("```\nflowchart LR\n0:startevent:((startevent))-->1:task:(A)\n1:task:(B)-->2:subprocess:(S)\n"
            "3:startevent:(s)-->4:inclusivegateway:{O}\n1:task:(a(b)-->|x|5:task:(C)")
    lns = P.lines(_models(spark, {"m": text}))
    rules = sorted((r.rule, r.node_id) for r in V.validate_lines(lns).collect())
    assert ("V1", None) in rules
    assert ("V4", "1") in rules
    assert ("V11", "2") in rules
    assert ("V8", "3") in rules
    assert ("V9", "4") in rules
    assert ("V12", None) in rules
    st = V.validation_status(lns.select("model_id").distinct(), V.validate_lines(lns)).collect()[0]
    assert st.status == 0 and st.n_errors == len(rules)


def _findings(spark, *lines):
    lns = spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "model_id string, line_no int, line string")
    f = V.validate_lines(lns)
    st = V.validation_status(lns.select("model_id").distinct(), f).first()
    return [(r.rule, r.node_id) for r in f.orderBy(F.col("rule") == "V12", "line_no", "tok_no", "seq").collect()], st


def test_every_validation_rule_has_its_finding(spark):
    rules, st = _findings(
        spark, "flowchart LR",
        "0:startevent:((startevent))-->1:task:(a)",     # fine
        "alone",                                        # V1
        "1-->2:task:(b)",                               # V2: no colon
        "1:task:(a)-->|x|e:task:(c)",                   # V3: an edge label without an id
        "1:task:(other)-->2:task:(2)",                  # V4: two labels, V5: no letters
        "3:task:(a(b)-->4:task:(d)",                    # V6: a parenthesis in the first label
        "5:middleevent:((e))-->6:endevent:(e)",         # V7: neither start nor end, V8: syntax
        "7:odd gateway:{x}-->8:task:(f)",               # no node: a blank in the type
        "7:inclusivegateway:{x}-->8:exclusivegateway:x",  # V9: type, V10: syntax
        "9:subprocess:(g)-->10:startevent:((s))",       # V11, and a second start event
    )
    assert rules == [("V1", None), ("V2", None), ("V3", "|x|e"), ("V4", "1"), ("V5", "2"), ("V6", "3"), ("V7", "5"), ("V8", "6"),
                     ("V9", "7"), ("V10", "8"), ("V11", "9"), ("V12", None)]
    assert st.status == 0 and st.n_errors == 12 and st.errors[-1] == V.MSG_MULTI_START
    assert st.errors[0] == "There are less nodes than allowed in line #2"


def test_errors_come_in_rule_order_and_the_model_error_last(spark):
    rules, st = _findings(spark, "0:startevent:((s))-->1:startevent:((s))", "2:task:(a)-->|x|e:odd:(b)", "bare")
    assert rules == [("V3", "|x|e"), ("V11", "|x|e"), ("V1", None), ("V12", None)]
    assert st.errors == ["There is a node than violate predefined structure in line #1", "Nodetype odd is not defined",
                         "There are less nodes than allowed in line #2", V.MSG_MULTI_START]


def test_repaired_json(spark):
    from flowmatch.operators import parse as P
    six = '"tasks": [], "events": [], "gateways": [], "pools": [], "sequenceFlows": [], "messageFlows": []'
    cases = {'x {"tasks":[1]} y': '{"tasks":[1], ' + six.replace('"tasks": [], ', "") + "}", "{ }": "{" + six + "}",
             '{"a":1,"a":2}': '{"a":1,"a":2, ' + six + "}", "{} {}": None, "{'a':1}": None, '{"a":[1,}': None, "none": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: (r.json, r.error) for r in P.repair_json(df, "t").collect()}
    assert got == {c: (want, want is None) for c, want in cases.items()}


def test_schema_checks(spark):
    els = spark.createDataFrame([("m", "pools", "p", "n", None, None), ("m", "pools", "q", None, None, "[]"), ("m", "tasks", "t", "n", "Odd", None),
                                 ("m", "gateways", "g", None, "Exclusive", None)],
                                "model_id string, list string, id string, name string, type string, lanes string")
    flw = spark.createDataFrame([("m", "sequenceFlows", "f", None, "t")], "model_id string, list string, id string, sourceRef string, targetRef string")
    got = sorted((r.id, r.field, r.problem) for r in V.schema_violations(els, flw).collect())
    assert got == [("f", "sourceRef", "missing"), ("p", "lanes", "missing"), ("q", "name", "missing"), ("t", "type", "not in enum")]
    models = spark.createDataFrame([("m", '{"tasks":[],"events":[],"gateways":[],"pools":[]}'), ("n", "oops")], "model_id string, json string")
    got = sorted((r.model_id, r.field) for r in V.missing_lists(models).collect())
    assert len(got) == 8 and got[:2] == [("m", "messageFlows"), ("m", "sequenceFlows")]


def test_names_by_id(spark):
    from flowmatch.operators import labels as L
    els = spark.createDataFrame([("m", "gateways", 0, "g", None), ("m", "tasks", 0, "t", "pay"), ("m", "pools", 0, "t", "pool")],
                                "model_id string, list string, pos int, id string, name string")
    flw = spark.createDataFrame([("m", "sequenceFlows", 0, "f")], "model_id string, list string, pos int, id string")
    ids = spark.createDataFrame([("m", x) for x in ("g", "t", "f", "none")], "model_id string, id string")
    assert {r.id: r.name for r in L.names_by_id(els, flw, ids).collect()} == {"g": "", "t": "pay", "f": "", "none": ""}


def test_deeply_nested_diagram(spark):
    import json as J
    from flowmatch.operators import diagram as D
    shape = {"resourceId": "t", "stencil": {"id": "Task"}, "properties": {"name": "deep"}, "outgoing": [], "childShapes": []}
    for i in range(20):
        lane = {"resourceId": f"l{i}", "stencil": {"id": "Lane"}, "properties": {"name": f"lane {i}"}, "outgoing": [], "childShapes": [shape]}
        shape = {"resourceId": f"p{i}", "stencil": {"id": "Pool"}, "properties": {"name": f"pool {i}"}, "outgoing": [], "childShapes": [lane]}
    top = {"resourceId": "d", "stencil": {"id": "BPMNDiagram"}, "properties": {}, "childShapes": [shape]}
    dg = spark.createDataFrame([(1, J.dumps(top))], "diagram_id int, json string")
    tr = D.transform(D.flatten_shapes(dg))
    assert [r.name for r in tr["elements"].where("list = 'tasks'").collect()] == ["deep"]
    out = J.loads(D.to_json(tr, dg).first().json)
    assert sorted(out) == sorted(["tasks", "events", "gateways", "pools", "sequenceFlows", "messageFlows"])
    assert len(out["pools"]) == 20 and out["events"] == [] and {p["lanes"][0]["name"] for p in out["pools"]} == {f"lane {i}" for i in range(20)}


def test_chained_lines(spark):
    text = "graph LR\n1:task:(a)-->|x|2:task:(b)-->3:task:(c)\nplain-->4:task:(d)-->words-->more\n5:task:(e)\nno-->thing\n"
    models = spark.createDataFrame([("m", text)], "model_id string, text string")
    rows = lambda **kw: [(r.id, r.sourceRef, r.targetRef, r.edge_label) for r in P.parse_models(models, **kw)["flows"].orderBy("edge_no").collect()]
    assert rows() == [("sf0", "1", "2", "x"), ("sf1", None, "4", None), ("sf2", "5", None, None)]
    assert rows(chain=True) == [("sf0", "1", "2", "x"), ("sf1", "2", "3", None), ("sf2", None, "4", None), ("sf3", "4", None, None), ("sf4", "5", None, None)]


def test_deep_diagrams_in_one_plan(spark):
    import json

    from flowmatch.operators import diagram as D

    def nest(depth, n=0):
        kind = "BPMNDiagram" if n == 0 else "Pool" if n % 2 else "Lane"
        inner = [nest(depth - 1, n + 1), {"resourceId": f"t{n}", "stencil": {"id": "Task"}, "childShapes": [{"resourceId": "deeper"}]}] if depth else []
        return {"resourceId": f"r{n}", "stencil": {"id": kind}, "properties": {"name": f"n{n}"}, "outgoing": [{"resourceId": f"o{n}"}], "childShapes": inner}
    texts = [("a", json.dumps(nest(40))), ("b", json.dumps(nest(1))), ("c", "{broken"), ("d", None), ("e", "[]"),
             ("f", '{"resourceId": 7, "stencil": {"id": "BPMNDiagram"}, "childShapes": {"a": 1}}')]
    df = spark.createDataFrame(texts, "diagram_id string, json string")
    shapes = D.flatten_shapes(df, keep=False)
    plan = shapes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "from_json" not in plan
    rows = shapes.collect()
    deep = {r.resourceId: r for r in rows if r.diagram_id == "a"}
    assert len(deep) == 81 and deep["r40"].depth == 40 and list(deep["r40"].pos) == [0] * 40
    assert deep["r39"].parent_category == "Lanes" and deep["r39"].parent_lane == "r38" and deep["t3"].n_children == 1
    assert list(deep["r5"].outgoing) == ["o5"] and deep["t5"].name_raw is None and "deeper" not in deep
    rest = {r.diagram_id: (r.resourceId, r.category, r.n_children) for r in rows if r.diagram_id in "cdef"}
    assert rest == {"c": (None, None, 0), "d": (None, None, 0), "e": (None, None, 0), "f": ("7", "Diagram", 0)}
    assert sorted(map(str, D.flatten_shapes(df).collect())) == sorted(map(str, rows))


def test_lines_of_one_row_group_go_to_many_tasks(spark):
    texts = spark.range(200).coalesce(1).select(F.col("id").alias("model_id"), F.lit("1:task:(a)-->2:endevent:((endevent))\nx").alias("text"))
    lns = P.lines(texts)
    tasks = lns.groupBy(F.spark_partition_id()).count().count()
    assert tasks >= spark.sparkContext.defaultParallelism and lns.count() == 400


def test_json_of_models_in_one_pass(spark):
    """Lists in order of place, missing ones empty; the elements are aggregated once, not once a list."""
    models = spark.createDataFrame([("m", "0:startevent:((startevent))-->7:task:(b)\n7:task:(b)-->3:task:(a)\n3:task:(a)-->9:exclusivegateway:{x}"), ("none", "no model")], "model_id string, text string")
    p = P.parse_models(models)
    out = P.model_json(p["elements"], p["flows"], models)
    got = {r.model_id: r.json for r in out.collect()}
    assert got["none"] == '{"tasks":[],"events":[],"gateways":[],"pools":[],"sequenceFlows":[],"messageFlows":[]}'
    assert got["m"].startswith('{"tasks":[{"id":"7","name":"b","type":"User"},{"id":"3","name":"a","type":"User"}],"events":[{"id":"0"')
    assert '"gateways":[{"id":"9","type":"Exclusive"}],"pools":[],"sequenceFlows":[{"id":"sf0","sourceRef":"0","targetRef":"7"}' in got["m"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 4
