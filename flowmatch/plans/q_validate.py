"""Validation queries (V1-V14): trace texts with injected faults.

Every event line is kept; a fault is injected by ``event_id % 13``:
0 -> the arrow and target are cut (V1), 1 -> the task type becomes an
unknown node type (V11), 2 -> the id becomes an edge-label id without
trailing digits (V3).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmatch.operators import labels as L
from flowmatch.operators import parse as P
from flowmatch.operators import validate as V
from flowmatch.plans import traces as T
from flowmatch.plans.registry import register
from flowmatch.session import cut_lineage
from flowmatch.sources.tables import table

_EV = """ev AS (
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, event_id, event_type FROM events)"""


def faulty_trace_lines(events):
    lns = T.trace_lines(events)
    eid = F.col("line_no")["event_id"]
    line = F.col("line")
    fault = (F.when(eid % 13 == 0, F.split(line, "-->", -1)[0])
             .when(eid % 13 == 1, F.regexp_replace(line, "^(-?\\d+):task:", "$1:activity:"))
             .when(eid % 13 == 2, F.regexp_replace(line, "^(-?\\d+):", "|x|$1e:"))
             .otherwise(line))
    return lns.withColumn("line", F.when(eid.isNull(), line).otherwise(fault))


@register("q_validate_rules", "WITH " + _EV + """
SELECT user_id, week, event_id,
       CASE event_id % 13 WHEN 0 THEN 'V1' WHEN 1 THEN 'V11' ELSE 'V3' END AS rule,
       CASE event_id % 13
         WHEN 0 THEN 'There are less nodes than allowed in line #' || CAST(event_id AS VARCHAR)
         WHEN 1 THEN 'Nodetype activity is not defined'
         ELSE 'There is a node than violate predefined structure in line #' || CAST(event_id AS VARCHAR)
       END AS message
FROM ev WHERE event_id % 13 IN (0, 1, 2)""")
def q_validate_rules(spark, sf_dir):
    """V1-V12 rule rows of the faulty trace texts."""
    ev = table(spark, sf_dir, "events")
    # the validator reads its lines from several branches: materialise them once
    lns = cut_lineage(faulty_trace_lines(ev).withColumn("line_no", F.col("line_no")["event_id"]))
    f = V.validate_lines(lns)
    return f.select(F.col("model_id")["user_id"].alias("user_id"), F.col("model_id")["week"].alias("week"),
                    F.col("line_no").alias("event_id"), "rule", "message")


_MESSAGE = """CASE event_id % 13
         WHEN 0 THEN 'There are less nodes than allowed in line #' || CAST(event_id AS VARCHAR)
         WHEN 1 THEN 'Nodetype activity is not defined'
         WHEN 2 THEN 'There is a node than violate predefined structure in line #' || CAST(event_id AS VARCHAR)
       END"""


@register("q_validate_status", "WITH " + _EV + f"""
SELECT user_id, week,
       CASE WHEN count({_MESSAGE}) = 0 THEN 1 ELSE 0 END AS status,
       count({_MESSAGE}) AS n_errors,
       coalesce(string_agg({_MESSAGE}, '; ' ORDER BY event_id), '') AS errors
FROM ev GROUP BY user_id, week""")
def q_validate_status(spark, sf_dir):
    """Status, error count and errors in order of every faulty trace text."""
    ev = table(spark, sf_dir, "events")
    lns = cut_lineage(faulty_trace_lines(ev).withColumn("line_no", F.col("line_no")["event_id"]))
    f = V.validate_lines(lns)
    models = T.traces(ev).select(T.model_key().alias("model_id"))
    st = V.validation_status(models, f)
    return st.select(F.col("model_id")["user_id"].alias("user_id"), F.col("model_id")["week"].alias("week"),
                     "status", "n_errors", F.concat_ws("; ", "errors").alias("errors"))


# One kind of finding for each remainder of the customer's key: the line that
# holds it, and the rule and message that it must give.
KINDS = {
    0: ("5:task:(lonely)", "V1", "There are less nodes than allowed in line #6"),
    1: ("plain-->4:endevent:((endevent))", "V2", "There is a node than violate predefined structure in line #6"),
    2: ("|if|x:task:(x)-->4:endevent:((endevent))", "V3", "There is a node than violate predefined structure in line #6"),
    3: ("1:task:(task Z)-->4:endevent:((endevent))", "V4", "Node #1 has multiple labels"),
    4: ("1:task:(12)-->4:endevent:((endevent))", "V5", "Node #1 has no label"),
    5: ("6:task:(a|b)-->4:endevent:((endevent))", "V6", "Node #6 violates the predefined rules"),
    6: ("6:timerevent:((timerevent))-->4:endevent:((endevent))", "V7", "Type of node #6 is not coresponding to the predefined format."),
    7: ("6:endevent:(endevent)-->4:endevent:((endevent))", "V8", "The syntax of node #6 is not coresponding to the predefined format."),
    8: ("6:eventbasedgateway:{x}-->4:endevent:((endevent))", "V7", "Type of node #6 is not coresponding to the predefined format."),
    9: ("6:inclusivegateway:{x}-->4:endevent:((endevent))", "V9", "Type of node #6 is not coresponding to the predefined format."),
    10: ("6:exclusivegateway:(x)-->4:endevent:((endevent))", "V10", "The syntax of node #6 is not coresponding to the predefined format."),
    11: ("6:subprocess:(x)-->4:endevent:((endevent))", "V11", "Nodetype subprocess is not defined"),
    12: ("7:startevent:((startevent))-->4:endevent:((endevent))", "V12", "There are multiple start events in the model."),
}
FINE = """flowchart LR

0:startevent:((startevent))-->1:task:(task A)
1:task:-->2:exclusivegateway:{x}
2:exclusivegateway:-->|yes|3:task:(task B)
3:task:(task B)-->4:endevent:((endevent))"""
_KIND_VALUES = ", ".join(f"({k}, '{rule}', '{message}')" for k, (_, rule, message) in KINDS.items())


def _customer_models(spark, sf_dir):
    line = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[0]))]), (F.col("c_custkey") % 14).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return c.select(F.col("c_custkey").alias("model_id"), F.concat_ws("\n", F.lit(FINE), "line").alias("text"))


@register("q_validate_kinds", f"""
SELECT c_custkey, rule, message FROM customer JOIN (VALUES {_KIND_VALUES}) k(k, rule, message) ON c_custkey % 14 = k""")
def q_validate_kinds(spark, sf_dir):
    """A whole model text for each customer with a finding of one
    kind (by ``c_custkey % 14``; 13: none) after lines with a gateway, an edge
    label, a repeated label and nodes that are named by id alone."""
    f = V.validate_lines(P.lines(_customer_models(spark, sf_dir)))
    return f.select(F.col("model_id").alias("c_custkey"), "rule", "message")


@register("q_names_by_id", """
WITH n AS (SELECT c_custkey, unnest(['0', '1', '2', '3', '4', '6', '7', 'sf0', 'zz']) AS id FROM customer)
SELECT c_custkey, id, CASE WHEN id = '0' THEN 'start' WHEN id = '4' THEN 'end' WHEN id = '3' THEN 'task B'
    WHEN id = '1' THEN CASE c_custkey % 14 WHEN 3 THEN 'task Z' WHEN 4 THEN '12' ELSE 'task A' END
    WHEN id = '6' AND c_custkey % 14 = 5 THEN 'a|b' WHEN id = '6' AND c_custkey % 14 = 7 THEN 'end'
    WHEN id = '7' AND c_custkey % 14 = 12 THEN 'start' ELSE '' END AS name FROM n""")
def q_names_by_id(spark, sf_dir):
    """Names of ids of every kind in the customers' models; an item
    without a name and an id that no list has give ''."""
    models = _customer_models(spark, sf_dir)
    p = P.parse_models(models)
    ids = models.select("model_id", F.explode(F.array(*[F.lit(i) for i in ("0", "1", "2", "3", "4", "6", "7", "sf0", "zz")])).alias("id"))
    flows = p["flows"].select("model_id", F.lit("sequenceFlows").alias("list"), F.col("edge_no").alias("pos"), "id")
    return L.names_by_id(p["elements"], flows, ids).select(F.col("model_id").alias("c_custkey"), "id", "name")


@register("q_schema_check", """
SELECT CAST(event_id AS VARCHAR) AS id, 'type' AS field, 'not in enum' AS problem
FROM events WHERE event_type NOT IN ('signup', 'purchase')
UNION ALL
SELECT CAST(event_id AS VARCHAR), 'name', 'missing' FROM events WHERE props IS NULL OR value > 95""")
def q_schema_check(spark, sf_dir):
    """Events as process events (signup = start, purchase = end, others
    keep their raw type) checked against the schema's required fields and
    event-type enumeration; a name is missing where value > 95."""
    ev = table(spark, sf_dir, "events")
    typ = (F.when(F.col("event_type") == "signup", "StartNoneEvent")
           .when(F.col("event_type") == "purchase", "EndNoneEvent").otherwise(F.col("event_type")))
    els = ev.select(F.lit(0).alias("model_id"), F.lit("events").alias("list"),
                    F.col("event_id").cast("string").alias("id"),
                    F.when(F.col("props").isNull() | (F.col("value") > 95), F.lit(None))
                    .otherwise(F.col("event_type")).alias("name"),
                    typ.alias("type"))
    return V.schema_violations(els).select("id", "field", "problem")
