"""Queries for the text operators (P1-P18) over the test tables.

Traces are written as model text line by line (plans/traces.py) and parsed
back; orders with their line items are the task lists of P11, P14, P17, P18
and the six-list documents of P10.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmatch.operators import parse as P
from flowmatch.operators.sequence import with_successor
from flowmatch.plans import traces as T
from flowmatch.plans.registry import register
from flowmatch.sources.tables import table

TRACE_EV = """ev AS (
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, ts, event_id, event_type FROM events)"""
TRACE_SEQ = TRACE_EV + """,
seq AS (
  SELECT *, lead(event_id) OVER w AS nid, lead(event_type) OVER w AS ntype,
         row_number() OVER w AS rn
  FROM ev WINDOW w AS (PARTITION BY user_id, week ORDER BY ts, event_id))"""


def _parsed_traces(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    lns = T.trace_lines(ev)
    models = T.traces(ev).select(T.model_key().alias("model_id"))
    return P.parse_lines(lns, models, number=False)


def _keys(c="model_id"):
    return [F.col(c)["user_id"].alias("user_id"), F.col(c)["week"].alias("week")]


@register("q_parse_nodes", "WITH " + TRACE_EV + """
SELECT user_id, week, 'task' AS kind, CAST(event_id AS VARCHAR) AS node_id, event_type AS value FROM ev
UNION ALL SELECT DISTINCT user_id, week, 'event', '-1', 'startevent' FROM ev
UNION ALL SELECT DISTINCT user_id, week, 'event', '-2', 'endevent' FROM ev""")
def q_parse_nodes(spark, sf_dir):
    """Nodes of every trace text (first position, last label per id)."""
    n = _parsed_traces(spark, sf_dir)["nodes"]
    return n.select(*_keys(), "kind", "node_id", "value")


@register("q_parse_edges", "WITH " + TRACE_SEQ + """
SELECT user_id, week, CAST(event_id AS VARCHAR) AS sourceRef,
       coalesce(CAST(nid AS VARCHAR), '-2') AS targetRef FROM seq
UNION ALL SELECT user_id, week, '-1', CAST(event_id AS VARCHAR) FROM seq WHERE rn = 1""")
def q_parse_edges(spark, sf_dir):
    """Flows of every trace text (source = token 0, target = token 1)."""
    f = _parsed_traces(spark, sf_dir)["flows"]
    return f.select(*_keys(), "sourceRef", "targetRef")


@register("q_parse_elements", "WITH " + TRACE_EV + """
SELECT user_id, week, 'tasks' AS list, CAST(event_id AS VARCHAR) AS id, event_type AS name, 'User' AS type FROM ev
UNION ALL SELECT DISTINCT user_id, week, 'events', '-1', 'start', 'StartNoneEvent' FROM ev
UNION ALL SELECT DISTINCT user_id, week, 'events', '-2', 'end', 'EndNoneEvent' FROM ev""")
def q_parse_elements(spark, sf_dir):
    """Normalised element table of every trace text."""
    e = _parsed_traces(spark, sf_dir)["elements"]
    return e.select(*_keys(), "list", "id", "name", "type")


@register("q_text_roundtrip", "WITH " + TRACE_SEQ + """
SELECT user_id, week,
       CAST(event_id AS VARCHAR) || ':task:(' || event_type || ') --> ' ||
       CASE WHEN nid IS NULL THEN '-2:endevent:((end event))'
            ELSE CAST(nid AS VARCHAR) || ':task:(' || ntype || ')' END AS line,
       TRUE AS complete
FROM seq
UNION ALL
SELECT user_id, week,
       '-1:startevent:((start event)) --> ' || CAST(event_id AS VARCHAR) || ':task:(' || event_type || ')',
       TRUE
FROM seq WHERE rn = 1""")
def q_text_roundtrip(spark, sf_dir):
    """Parsed traces written back as ``src --> dst`` lines."""
    p = _parsed_traces(spark, sf_dir)
    el = P.edge_lines(p["elements"], p["flows"])
    return el.select(*_keys(), "line", "complete")


def _order_tasks(spark, sf_dir):
    """(l_orderkey, pos, l_linenumber, l_partkey, l_suppkey, task) per line item."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    t = li.join(part, "l_partkey")
    return t.select("l_orderkey",
                    F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                             "l_shipdate").alias("pos"),
                    "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("task"))


@register("q_next_id", """
SELECT o_orderkey, CAST(max(l_linenumber) + 1 AS BIGINT) AS next_id
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_next_id(spark, sf_dir):
    """Next free numeric id of each order's element table."""
    li = table(spark, sf_dir, "lineitem")
    els = li.select(F.col("l_orderkey").alias("model_id"), F.lit("tasks").alias("list"),
                    F.col("l_linenumber").cast("string").alias("id"))
    nid = P.next_free_id(els)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"))
    return o.join(nid.withColumnRenamed("model_id", "o_orderkey"), "o_orderkey", "left")


def _order_lines(spark, sf_dir):
    t = _order_tasks(spark, sf_dir)
    return t.select(F.col("l_orderkey").alias("model_id"), F.col("pos").alias("line_no"),
                    F.concat(F.col("l_linenumber").cast("string"), F.lit(":task:("), F.col("task"),
                             F.lit(")")).alias("line"))


@register("q_task_labels", """
SELECT l_orderkey, p_name AS label, min(l_linenumber) AS first_line
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_name""")
def q_task_labels(spark, sf_dir):
    """Unique task labels of each order in first-seen order."""
    tl = P.task_labels(_order_lines(spark, sf_dir))
    return tl.select(F.col("model_id").alias("l_orderkey"), "label",
                     F.col("first_pos")["line_no"]["l_linenumber"].alias("first_line"))


@register("q_task_info", """
SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS tasks, count(DISTINCT p_name) AS number,
       '{"tasks":' || to_json(list_sort(list(DISTINCT p_name))) || ',"number":' ||
       CAST(count(DISTINCT p_name) AS VARCHAR) || '}' AS json
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def q_task_info(spark, sf_dir):
    """Sorted unique task list and its size, as columns and JSON."""
    tl = P.task_labels(_order_lines(spark, sf_dir))
    info = P.task_info(tl.select("model_id", "label"))
    return info.select(F.col("model_id").alias("l_orderkey"),
                       F.from_json("json", "tasks array<string>")["tasks"].alias("tasks"),
                       F.col("number").cast("long").alias("number"), "json")


@register("q_task_compare", """
WITH o AS (
  SELECT o_custkey, o_orderkey,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_orderkey
  FROM orders),
p AS (SELECT * FROM o WHERE next_orderkey IS NOT NULL),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS task,
             lower(replace(p_name, ' ', '')) AS k
      FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT p.o_custkey, p.o_orderkey, p.next_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.task, t.k
      FROM p JOIN t ON t.l_orderkey = p.o_orderkey),
b AS (SELECT p.o_custkey, p.o_orderkey, p.next_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.task, t.k
      FROM p JOIN t ON t.l_orderkey = p.next_orderkey)
SELECT o_custkey, o_orderkey, next_orderkey, l_linenumber, l_partkey, l_suppkey, task,
       CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = a.o_orderkey AND b.k = a.k)
            THEN 'ident' ELSE 'not_ident1' END AS status
FROM a
UNION ALL
SELECT o_custkey, o_orderkey, next_orderkey, l_linenumber, l_partkey, l_suppkey, task, 'not_ident2'
FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = b.o_orderkey AND a.k = b.k)""")
def q_task_compare(spark, sf_dir):
    """Each order's tasks against the same customer's next order (exact,
    case- and space-insensitive)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    succ, _ = with_successor(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"],
                             bucket=F.date_trunc("month", F.col("o_orderdate")))
    pairs = succ.where(F.col("next_o_orderkey").isNotNull()).select(
        "o_custkey", "o_orderkey", F.col("next_o_orderkey").alias("next_orderkey"))
    t = _order_tasks(spark, sf_dir).drop("pos")
    keys = ["o_custkey", "o_orderkey", "next_orderkey"]
    t1 = pairs.join(t.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    t2 = pairs.join(t.withColumnRenamed("l_orderkey", "next_orderkey"), "next_orderkey")
    out = P.compare_tasks(t1, t2, keys)
    return out.select(*keys, "l_linenumber", "l_partkey", "l_suppkey", "task", "status")


@register("q_json_repair", """
WITH g AS (
  SELECT event_id,
         CASE WHEN event_id % 11 = 0 THEN 'model: ' || substr(props, 1, length(props) - 1)
              ELSE 'Here is the model: ' || props || ' -- done' END AS gen
  FROM events),
x AS (SELECT event_id, regexp_extract(gen, '(?s)(\\{.*\\})', 1) AS js FROM g)
SELECT event_id,
       CASE WHEN json_valid(js) AND js <> '' THEN CAST(json_extract_string(js, '$.k') AS BIGINT) END AS k,
       NOT (json_valid(js) AND js <> '') AS error,
       CASE WHEN json_valid(js) AND js <> '' THEN
         CAST(len(list_filter(['tasks', 'events', 'gateways', 'pools', 'sequenceFlows', 'messageFlows'],
                          lambda q: NOT list_contains(json_keys(js), q))) AS INTEGER) END AS added_keys,
       CASE WHEN json_valid(js) AND js <> '' THEN
         regexp_replace(js, '\\s*\\}$', '') ||
         ', "tasks": [], "events": [], "gateways": [], "pools": [], "sequenceFlows": [], "messageFlows": []}' END AS json
FROM x""")
def q_json_repair(spark, sf_dir):
    """Generated text wrapped around a JSON object (some cut short)
    -> the object completed with the lists it lacks, an error flag and the
    number of lists added."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    gen = F.when(F.col("event_id") % 11 == 0,
                 F.concat(F.lit("model: "), F.expr("substring(props, 1, length(props) - 1)"))) \
           .otherwise(F.concat(F.lit("Here is the model: "), F.col("props"), F.lit(" -- done")))
    rep = P.repair_json(ev.select("event_id", gen.alias("gen")), "gen")
    return rep.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"),
                      "error", "added_keys", "json")


@register("q_model_json", """
WITH t AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
x AS (SELECT k, n, lead(n) OVER w AS nx, row_number() OVER w - 1 AS r FROM t WINDOW w AS (PARTITION BY k ORDER BY n)),
c AS (SELECT k,
        string_agg('{"id":"' || n || '","name":"item ' || n || '","type":"User"}', ',' ORDER BY n) AS tasks,
        string_agg('{"id":"sf' || r || '","sourceRef":"' || n || '","targetRef":"' || coalesce(nx, 0) || '"}', ',' ORDER BY n) AS flows
      FROM x GROUP BY k)
SELECT o_orderkey, '{"tasks":[' || coalesce(tasks, '') || '],"events":[],"gateways":[],"pools":[],"sequenceFlows":['
       || coalesce(flows, '') || '],"messageFlows":[]}' AS json
FROM orders LEFT JOIN c ON c.k = o_orderkey""")
def q_model_json(spark, sf_dir):
    """One six-list JSON document per order (line items as tasks,
    consecutive line numbers as flows, the last to an end marker without a
    node); an order without items has six empty lists."""
    # an order is dealt once: its lines, elements and flows stay together, as its document is one row
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()
    succ, _ = with_successor(li, ["l_orderkey"], ["l_linenumber"], ["l_linenumber"], bucket=None)
    nxt = F.coalesce(F.col("next_l_linenumber").cast("string"), F.lit("0"))
    lns = succ.select(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("line_no"),
                      F.concat(F.col("l_linenumber").cast("string"), F.lit(":task:(item "),
                               F.col("l_linenumber").cast("string"), F.lit(")-->"), nxt,
                               F.lit(":end:")).alias("line"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("model_id"))
    p = P.parse_lines(lns, orders)
    js = P.model_json(p["elements"], p["flows"], orders)
    return js.select(F.col("model_id").alias("o_orderkey"), "json")


_CHAIN_SEQ = """
WITH t AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i FROM lineitem),
s AS (SELECT *, max(i) OVER (PARTITION BY l_orderkey) AS n, lead(i) OVER w AS ni, lead(l_partkey) OVER w AS np
      FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))"""


def _order_texts(spark, sf_dir):
    """Whole model texts: an order's items as one chained line with edge labels
    on every third step, between a header and a line with a gateway."""
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", pos.alias("p"))
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("items"))  # an order has a few items

    def token(x, i):
        label = F.when(i % 3 == 2, F.concat(F.lit("|if "), i.cast("string"), F.lit("| "))).otherwise(F.lit(""))
        return F.concat(label, (i + 1).cast("string"), F.lit(":task:(part "), x["l_partkey"].cast("string"), F.lit(")"))
    chain = F.array_join(F.transform("items", token), " --> ")
    last = F.size("items").cast("string")
    text = F.concat(F.lit("flowchart LR\n"), chain, F.lit("\nplain --> words\n"), last, F.lit(":task:(part) --> g0:exclusivegateway:{x}\n"))
    return items.select(F.col("l_orderkey").alias("model_id"), text.alias("text"))


@register("q_parse_chains", _CHAIN_SEQ + """
SELECT l_orderkey, 'sf' || CAST(greatest(i - 1, 0) AS VARCHAR) AS id, CAST(i AS VARCHAR) AS sourceRef, CAST(ni AS VARCHAR) AS targetRef,
       CASE WHEN i % 3 = 2 AND ni IS NOT NULL THEN 'if ' || CAST(i AS VARCHAR) END AS edge_label
FROM s WHERE ni IS NOT NULL OR n = 1
UNION ALL
SELECT l_orderkey, 'sf' || CAST(greatest(n - 1, 1) AS VARCHAR), CAST(n AS VARCHAR), 'g0', NULL FROM s WHERE i = n""")
def q_parse_chains(spark, sf_dir):
    """P1, P2, P4, P8 with ``chain``: whole texts split into lines, a line of
    several arrows giving a flow for each, with its edge label."""
    p = P.parse_models(_order_texts(spark, sf_dir), chain=True)
    return p["flows"].select(F.col("model_id").alias("l_orderkey"), "id", "sourceRef", "targetRef", "edge_label")


@register("q_parse_strict", _CHAIN_SEQ + """
SELECT l_orderkey, 'sf0' AS id, '1' AS sourceRef, CASE WHEN n > 1 THEN '2' END AS targetRef, CAST(NULL AS VARCHAR) AS edge_label FROM s WHERE i = 1
UNION ALL
SELECT l_orderkey, 'sf1', CAST(n AS VARCHAR), 'g0', NULL FROM s WHERE i = n""")
def q_parse_strict(spark, sf_dir):
    """P1, P2, P4, P8 as the converter has them: the first two tokens of a line
    make its flow, whatever follows."""
    p = P.parse_models(_order_texts(spark, sf_dir))
    return p["flows"].select(F.col("model_id").alias("l_orderkey"), "id", "sourceRef", "targetRef", "edge_label")
