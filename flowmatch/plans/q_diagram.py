"""Nested diagram queries (B1-B15): one diagram document per customer.

Diagram of customer ``k``: a pool named after the region holding one lane
named after the nation, the lane holding the customer as a task (type = the
market segment, or the stencil when the segment is ``None``-like), a start
event and a gateway; a second pool ``Bank`` without lanes; three sequence
flows, one message flow, a data object (dropped).  Faults: ``k % 7 = 0`` the
task has a child, ``k % 11 = 0`` the lane has an outgoing flow, ``k % 13 = 0``
an unknown stencil is added.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmatch.operators import diagram as D
from flowmatch.operators import labels as L
from flowmatch.plans.registry import register
from flowmatch.session import spread
from flowmatch.sources.tables import table


def _obj(rid, stencil, name=None, tasktype=None, outgoing=None, target=None, children=None):
    """JSON text of one shape, assembled with built-in string functions."""
    parts = [F.lit('{"resourceId":"'), rid, F.lit('","stencil":{"id":"'), stencil, F.lit('"},"properties":{')]
    pr = []
    if name is not None:
        pr.append(F.concat(F.lit('"name":'), F.regexp_extract(F.to_json(F.struct(name.alias("n"))), '^\\{"n":(.*)\\}$', 1)))
    if tasktype is not None:
        pr.append(F.concat(F.lit('"tasktype":"'), tasktype, F.lit('"')))
    parts.append(F.concat_ws(",", *pr) if pr else F.lit(""))
    parts.append(F.lit("}"))
    if outgoing is not None:
        parts += [F.lit(',"outgoing":['), outgoing, F.lit("]")]
    if target is not None:
        parts += [F.lit(',"target":{"resourceId":"'), target, F.lit('"}')]
    if children is not None:
        parts += [F.lit(',"childShapes":['), children, F.lit("]")]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def _ref(x):
    return F.concat(F.lit('{"resourceId":"'), x, F.lit('"}'))


def diagrams(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    d = c.join(n, "c_nationkey").join(r, "n_regionkey")
    k = F.col("c_custkey").cast("string")
    idf = lambda p: F.concat(F.lit(p), k)
    tt = F.when(F.col("c_custkey") % 3 == 0, F.lit("None")).otherwise(F.col("c_mktsegment"))
    inner = _obj(idf("x"), F.lit("Task"), name=F.lit("inner"))
    task = _obj(idf("t"), F.lit("Task"), name=F.col("c_name"), tasktype=tt, outgoing=_ref(idf("sf")),
                children=F.when(F.col("c_custkey") % 7 == 0, inner).otherwise(F.lit("")))
    start = _obj(idf("s"), F.lit("StartNoneEvent"), name=F.lit("begin\nhere "), outgoing=_ref(idf("sf0_")))
    gw = _obj(idf("g"), F.when(F.col("c_custkey") % 2 == 0, F.lit("Exclusive_Databased_Gateway"))
              .otherwise(F.lit("ParallelGateway")), name=F.lit(""), outgoing=_ref(idf("sf2_")))
    lane = _obj(idf("l"), F.lit("Lane"), name=F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")),
                outgoing=F.when(F.col("c_custkey") % 11 == 0, _ref(F.lit("zz"))).otherwise(F.lit("")),
                children=F.concat_ws(",", task, start, gw))
    pool = _obj(idf("p"), F.lit("Pool"), name=F.col("r_name"), children=lane)
    bank = _obj(idf("q"), F.lit("CollapsedPool"), name=F.lit("Bank"), outgoing=_ref(idf("mf")))
    sf0 = _obj(idf("sf0_"), F.lit("SequenceFlow"), name=F.lit(""), target=idf("t"))
    sf = _obj(idf("sf"), F.lit("SequenceFlow"),
              name=F.when(F.col("c_acctbal") > 0, F.lit("positive")).otherwise(F.lit("")), target=idf("g"))
    sf2 = _obj(idf("sf2_"), F.lit("SequenceFlow"), name=F.lit(""), target=idf("p"))
    mf = _obj(idf("mf"), F.lit("MessageFlow"), name=F.lit("invoice"), target=idf("t"))
    data = _obj(idf("d"), F.lit("DataObject"), name=F.lit("doc"))
    unknown = F.when(F.col("c_custkey") % 13 == 0, _obj(idf("u"), F.lit("Blob"), name=F.lit("?")))
    kids = F.concat_ws(",", pool, bank, sf0, sf, sf2, mf, data, unknown)
    diag = _obj(idf("dg"), F.lit("BPMNDiagram"), children=kids)
    return d.select(F.col("c_custkey").alias("diagram_id"), diag.alias("json"))


def _transformed(spark, sf_dir):
    dg = diagrams(spark, sf_dir)
    shapes = D.flatten_shapes(dg)
    return dg, shapes, D.transform(shapes)


_BASE = """
b AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS ks, c_name, c_acctbal, c_mktsegment,
         trim(n_name) AS n_name, r_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@register("q_flatten_elements", "WITH " + _BASE + """
SELECT k AS c_custkey, 'tasks' AS list, 't' || ks AS id, c_name AS name,
       CASE WHEN k % 3 = 0 THEN 'Task' ELSE c_mktsegment END AS type, 'l' || ks AS parent_lane,
       NULL AS targetRef, NULL AS condition FROM b
UNION ALL SELECT k, 'events', 's' || ks, 'begin here', 'StartNoneEvent', 'l' || ks, NULL, NULL FROM b
UNION ALL SELECT k, 'gateways', 'g' || ks, NULL,
       CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END, 'l' || ks, NULL, NULL FROM b
UNION ALL SELECT k, 'pools', 'p' || ks, r_name, NULL, '', NULL, NULL FROM b
UNION ALL SELECT k, 'pools', 'q' || ks, 'Bank', NULL, '', NULL, NULL FROM b
UNION ALL SELECT k, 'sequenceFlows', 'sf0_' || ks, NULL, NULL, '', 't' || ks, NULL FROM b
UNION ALL SELECT k, 'sequenceFlows', 'sf' || ks, NULL, NULL, '', 'g' || ks,
       CASE WHEN c_acctbal > 0 THEN 'positive' END FROM b
UNION ALL SELECT k, 'sequenceFlows', 'sf2_' || ks, NULL, NULL, '', 'p' || ks, NULL FROM b
UNION ALL SELECT k, 'messageFlows', 'mf' || ks, NULL, NULL, '', 't' || ks, 'invoice' FROM b""")
def q_flatten_elements(spark, sf_dir):
    """Flattened elements of every diagram (names cleaned, task and
    gateway types normalised, flow targets and conditions)."""
    _, shapes, _ = _transformed(spark, sf_dir)
    e = D.elements(shapes)
    return e.select(F.col("diagram_id").alias("c_custkey"), "list", "id", "name", "type", "parent_lane",
                    "targetRef", "condition")


@register("q_flow_source", "WITH " + _BASE + """
SELECT k AS c_custkey, 'sf0_' || ks AS id, 's' || ks AS sourceRef FROM b
UNION ALL SELECT k, 'sf' || ks, 't' || ks FROM b
UNION ALL SELECT k, 'sf2_' || ks, 'g' || ks FROM b
UNION ALL SELECT k, 'mf' || ks, 'q' || ks FROM b""")
def q_flow_source(spark, sf_dir):
    """Each flow's source = the element whose outgoing lists it."""
    _, _, tr = _transformed(spark, sf_dir)
    return tr["flows"].select(F.col("diagram_id").alias("c_custkey"), "id", "sourceRef")


@register("q_flow_values", "WITH " + _BASE + """
SELECT k AS c_custkey, 'sequenceFlows' AS list, 'begin here  ' || c_name AS flow FROM b
UNION ALL SELECT k, 'sequenceFlows', c_name || ' ' || CASE WHEN c_acctbal > 0 THEN 'positive' ELSE '' END
       || ' ' || CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END FROM b
UNION ALL SELECT k, 'sequenceFlows', CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END || '  ' || r_name FROM b
UNION ALL SELECT k, 'messageFlows', 'Bank  ' || c_name FROM b""")
def q_flow_values(spark, sf_dir):
    """Flows with endpoint ids replaced by names (tasks, events,
    pools) or gateway types; message flows carry an empty middle."""
    _, _, tr = _transformed(spark, sf_dir)
    fs = L.flow_strings(tr["elements"].withColumnRenamed("diagram_id", "model_id"),
                        tr["flows"].withColumnRenamed("diagram_id", "model_id"))
    return fs.select(F.col("model_id").alias("c_custkey"), "list", "flow")


@register("q_lane_names", "WITH " + _BASE + """
SELECT k AS c_custkey, 'lanes' AS category, r_name || ' - ' || n_name AS label FROM b
UNION ALL SELECT k, 'lanes', 'Bank' FROM b
UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - ' || c_name FROM b
UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - begin here' FROM b
UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - ' ||
       CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END FROM b""")
def q_lane_names(spark, sf_dir):
    """``pool - lane`` names (a pool without lanes by its name) and
    ``pool - lane - element`` references."""
    _, _, tr = _transformed(spark, sf_dir)
    ren = lambda df: df.withColumnRenamed("diagram_id", "model_id")
    lanes_lbl, refs = L.lane_strings(ren(tr["elements"]), ren(tr["lanes"]), ren(tr["lane_refs"]))
    out = (lanes_lbl.select("model_id", F.lit("lanes").alias("category"), "label")
           .unionByName(refs.select("model_id", F.lit("lanes_with_refs").alias("category"), "label")))
    return out.select(F.col("model_id").alias("c_custkey"), "category", "label")


@register("q_lane_refs", "WITH " + _BASE + """
SELECT k AS c_custkey, 'l' || ks AS lane_id, ['t' || ks, 's' || ks, 'g' || ks] AS elemRefs FROM b""")
def q_lane_refs(spark, sf_dir):
    """Element references of each lane, in list then position order."""
    _, _, tr = _transformed(spark, sf_dir)
    r = (tr["lane_refs"].groupBy("diagram_id", "lane_id")
         .agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "ref_id"))),
                          lambda x: x["ref_id"]).alias("elemRefs")))
    return r.select(F.col("diagram_id").alias("c_custkey"), "lane_id", "elemRefs")


@register("q_diagram_transform", """
SELECT c_custkey, 1 AS n_tasks, 1 AS n_events, 1 AS n_gateways, 2 AS n_pools, 1 AS n_lanes,
       3 AS n_sequence_flows, 1 AS n_message_flows FROM customer""")
def q_diagram_transform(spark, sf_dir):
    """The six-list JSON of every diagram, checked by its list lengths."""
    dg, _, tr = _transformed(spark, sf_dir)
    js = D.to_json(tr, dg)
    n = lambda p: F.coalesce(F.json_array_length(F.get_json_object("json", p)), F.lit(0))
    return js.select(F.col("diagram_id").alias("c_custkey"), n("$.tasks").alias("n_tasks"),
                     n("$.events").alias("n_events"), n("$.gateways").alias("n_gateways"),
                     n("$.pools").alias("n_pools"), n("$.pools[0].lanes").alias("n_lanes"),
                     n("$.sequenceFlows").alias("n_sequence_flows"),
                     n("$.messageFlows").alias("n_message_flows"))


@register("q_diagram_json", "WITH " + _BASE + """
SELECT k AS c_custkey,
  '{"tasks":[{"id":"t' || ks || '","name":"' || c_name || '","type":"' || CASE WHEN k % 3 = 0 THEN 'Task' ELSE c_mktsegment END || '"}],' ||
  '"events":[{"id":"s' || ks || '","name":"begin here","type":"StartNoneEvent"}],' ||
  '"gateways":[{"id":"g' || ks || '","type":"' || CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END || '"}],' ||
  '"pools":[{"id":"p' || ks || '","name":"' || r_name || '","lanes":[{"id":"l' || ks || '","name":"' || n_name ||
     '","elemRefs":["t' || ks || '","s' || ks || '","g' || ks || '"]}]},{"id":"q' || ks || '","name":"Bank","lanes":[]}],' ||
  '"sequenceFlows":[{"id":"sf0_' || ks || '","sourceRef":"s' || ks || '","targetRef":"t' || ks || '"},' ||
     '{"id":"sf' || ks || '","sourceRef":"t' || ks || '","targetRef":"g' || ks || '"' || CASE WHEN c_acctbal > 0 THEN ',"condition":"positive"' ELSE '' END || '},' ||
     '{"id":"sf2_' || ks || '","sourceRef":"g' || ks || '","targetRef":"p' || ks || '"}],' ||
  '"messageFlows":[{"id":"mf' || ks || '","sourceRef":"q' || ks || '","targetRef":"t' || ks || '","label":"invoice"}]}' AS json
FROM b""")
def q_diagram_json(spark, sf_dir):
    """The whole six-list JSON text of every diagram."""
    dg, _, tr = _transformed(spark, sf_dir)
    return D.to_json(tr, dg).select(F.col("diagram_id").alias("c_custkey"), "json")


@register("q_structure_violations", """
SELECT c_custkey, 't' || CAST(c_custkey AS VARCHAR) AS id, 'leaf with children' AS problem
FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'l' || CAST(c_custkey AS VARCHAR), 'lane with outgoing' FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 'u' || CAST(c_custkey AS VARCHAR), 'unknown stencil' FROM customer WHERE c_custkey % 13 = 0""")
def q_structure_violations(spark, sf_dir):
    """Structural findings of every diagram."""
    _, shapes, _ = _transformed(spark, sf_dir)
    return D.violations(shapes).select(F.col("diagram_id").alias("c_custkey"), "id", "problem")


_STENCIL = {"signup": "StartNoneEvent", "purchase": "EndNoneEvent", "view": "Task",
            "click": "ParallelGateway", "error": "ErrorShape"}


@register("q_stencil_lookup", """
WITH m AS (SELECT * FROM (VALUES ('signup', 'StartNoneEvent'), ('purchase', 'EndNoneEvent'), ('view', 'Task'),
                                 ('click', 'ParallelGateway'), ('error', 'ErrorShape')) t(event_type, stencil))
SELECT event_id, m.stencil,
       CASE m.stencil WHEN 'StartNoneEvent' THEN 'Events' WHEN 'EndNoneEvent' THEN 'Events'
                      WHEN 'Task' THEN 'Activities' WHEN 'ParallelGateway' THEN 'Gateways' END AS category,
       CASE m.stencil WHEN 'ParallelGateway' THEN 'Parallel' WHEN 'Task' THEN 'Task'
                      WHEN 'StartNoneEvent' THEN 'StartNoneEvent' WHEN 'EndNoneEvent' THEN 'EndNoneEvent' END AS type
FROM events JOIN m ON m.event_type = events.event_type""")
def q_stencil_lookup(spark, sf_dir):
    """Event types as stencils -> category (broadcast join on the
    fixed 66-row map; unknown stencils get NULL) and normalised type."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    m = spark.createDataFrame(list(_STENCIL.items()), "event_type string, stencil string")
    x = ev.join(F.broadcast(m), "event_type").join(F.broadcast(D.stencil_map(spark)), "stencil", "left")
    gw = F.create_map(*[v for kv in D.GATEWAY_TYPE.items() for v in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("stencil")]
    typ = (F.when(F.col("category") == "Gateways", F.coalesce(gw, F.col("stencil")))
           .when(F.col("category").isin("Events", "Activities"), F.col("stencil")))
    return x.select("event_id", "stencil", "category", typ.alias("type"))


def _diagram_counts(spark, sf_dir):
    """Label counts of every diagram, and which of them can be scored."""
    from flowmatch.operators import score as S
    dg, shapes, tr = _transformed(spark, sf_dir)
    ren = lambda df: df.withColumnRenamed("diagram_id", "model_id")
    labels = L.model_labels(ren(tr["elements"]), ren(tr["flows"]), ren(tr["lanes"]), ren(tr["lane_refs"]))
    return S.label_counts(labels), D.scorable_flags(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("diagram_id")), shapes, tr)


_DIAGRAM_LABELS = """
lab AS (
  SELECT k, 'task_names' AS category, c_name AS label FROM b
  UNION ALL SELECT k, 'task_types', CASE WHEN k % 3 = 0 THEN 'Task' ELSE c_mktsegment END FROM b
  UNION ALL SELECT k, 'event_names', 'begin here' FROM b
  UNION ALL SELECT k, 'event_types', 'StartNoneEvent' FROM b
  UNION ALL SELECT k, 'gateway_types', CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END FROM b
  UNION ALL SELECT k, 'seq_flows', 'begin here  ' || c_name FROM b
  UNION ALL SELECT k, 'seq_flows', c_name || ' ' || CASE WHEN c_acctbal > 0 THEN 'positive' ELSE '' END
         || ' ' || CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END FROM b
  UNION ALL SELECT k, 'seq_flows', CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END || '  ' || r_name FROM b
  UNION ALL SELECT k, 'mes_flows', 'Bank  ' || c_name FROM b
  UNION ALL SELECT k, 'lanes', r_name || ' - ' || n_name FROM b
  UNION ALL SELECT k, 'lanes', 'Bank' FROM b
  UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - ' || c_name FROM b
  UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - begin here' FROM b
  UNION ALL SELECT k, 'lanes_with_refs', r_name || ' - ' || n_name || ' - ' ||
         CASE WHEN k % 2 = 0 THEN 'Exclusive' ELSE 'Parallel' END FROM b),
cnt AS (SELECT k, category, label, count(*) AS c FROM lab GROUP BY k, category, label),
pp AS (SELECT * FROM (SELECT c_custkey AS k1,
                             lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k2
                      FROM customer) WHERE k2 IS NOT NULL),
sides AS (
  SELECT pp.k1, pp.k2, a.category, a.label, a.c AS c1, 0 AS c2 FROM pp JOIN cnt a ON a.k = pp.k1
  UNION ALL
  SELECT pp.k1, pp.k2, b.category, b.label, 0 AS c1, b.c AS c2 FROM pp JOIN cnt b ON b.k = pp.k2),
perlabel AS (SELECT k1, k2, category, label, sum(c1) AS c1, sum(c2) AS c2
             FROM sides GROUP BY k1, k2, category, label)"""


def _diagram_score_sql():
    from flowmatch.operators import score as S
    from flowmatch.plans import oracle as O
    ok = " AND ".join(f"k{i} % {d} <> 0" for i in (1, 2) for d in (7, 11, 13))
    cols = ", ".join(f"CASE WHEN {ok} THEN {c} {'ELSE 0.0 ' if c == 'overall' else ''}END AS {c}" for c in S.SCORE_COLUMNS)
    return ("WITH " + _BASE + "," + _DIAGRAM_LABELS + ", st AS (" + O.stats_select(["k1", "k2"], "perlabel")
            + "), sc AS (SELECT k1, k2, " + O.score_select("dice")
            + f" FROM st)\nSELECT k1 AS c_custkey, k2 AS next_custkey, {cols}, ({ok}) AND is_exact AS is_exact FROM sc")


@register("q_diagram_scores", _diagram_score_sql())
def q_diagram_scores(spark, sf_dir):
    """B11 + M2-M5 on diagrams: each customer's diagram against the next
    customer's of the same nation, all ten label categories (lanes, lane
    references and message flows included); a pair with a diagram that has a
    structural finding scores 0."""
    from flowmatch.operators import score as S
    from flowmatch.operators.sequence import with_successor
    counts, flags = _diagram_counts(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    succ, _ = with_successor(c, ["c_nationkey"], ["c_custkey"], ["c_custkey"],
                             bucket=F.floor(F.col("c_custkey") / 1024), coarser=lambda b: F.floor(b / 1024))
    pairs = succ.where(F.col("next_c_custkey").isNotNull()).select(
        F.col("c_custkey"), F.col("next_c_custkey").alias("next_custkey"),
        F.col("c_custkey").alias("m1"), F.col("next_c_custkey").alias("m2"))
    return S.score_pairs(pairs, counts, pairs_unique=True, model_flags=flags).drop("m1", "m2")
