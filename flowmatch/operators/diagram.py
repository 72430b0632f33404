"""Nested diagram JSON -> six-list element tables.

A diagram is a recursive ``shape`` (resourceId, stencil.id, properties.name /
tasktype, outgoing[], target, childShapes[]).  Its text is parsed once, to a
VARIANT; a recursive query explodes the child shapes level by level, so
recursion depth (not data size) decides the number of steps, and no JSON is
written again.  Only Diagram children and children of lanes inside pools are
descended into, as the flattener does.  ``pos`` is the child-index path, whose
order is the depth-first visiting order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmatch.functions.text import strip
from flowmatch.session import cut_lineage

# Stencil id -> category (66 entries).
STENCIL_CATEGORY = {
    "BPMNDiagram": "Diagram",
    "Task": "Activities", "CollapsedSubprocess": "Activities", "Subprocess": "Activities",
    "CollapsedEventSubprocess": "Activities", "EventSubprocess": "Activities",
    "Exclusive_Databased_Gateway": "Gateways", "EventbasedGateway": "Gateways",
    "ParallelGateway": "Gateways", "InclusiveGateway": "Gateways", "ComplexGateway": "Gateways",
    "Pool": "Pools", "CollapsedPool": "Pools", "Lane": "Lanes", "VerticalPool": "Pools",
    "CollapsedVerticalPool": "Pools", "VerticalLane": "Lanes",
    "processparticipant": "Artifacts", "Group": "Artifacts", "TextAnnotation": "Artifacts",
    "DataObject": "Data Elements", "ITSystem": "Artifacts", "DataStore": "Data Elements",
    "Message": "Data Elements",
    "StartNoneEvent": "Events", "StartMessageEvent": "Events", "StartTimerEvent": "Events",
    "StartEscalationEvent": "Events", "StartConditionalEvent": "Events", "StartErrorEvent": "Events",
    "StartCompensationEvent": "Events", "StartSignalEvent": "Events", "StartMultipleEvent": "Events",
    "StartParallelMultipleEvent": "Events", "IntermediateMessageEventCatching": "Events",
    "IntermediateTimerEvent": "Events", "IntermediateEscalationEvent": "Events",
    "IntermediateConditionalEvent": "Events", "IntermediateLinkEventCatching": "Events",
    "IntermediateErrorEvent": "Events", "IntermediateCancelEvent": "Events",
    "IntermediateCompensationEventCatching": "Events", "IntermediateSignalEventCatching": "Events",
    "IntermediateMultipleEventCatching": "Events", "IntermediateParallelMultipleEventCatching": "Events",
    "IntermediateEvent": "Events", "IntermediateMessageEventThrowing": "Events",
    "IntermediateEscalationEventThrowing": "Events", "IntermediateLinkEventThrowing": "Events",
    "IntermediateCompensationEventThrowing": "Events", "IntermediateSignalEventThrowing": "Events",
    "IntermediateMultipleEventThrowing": "Events", "EndNoneEvent": "Events",
    "EndMessageEvent": "Events", "EndEscalationEvent": "Events", "EndErrorEvent": "Events",
    "EndCancelEvent": "Events", "EndCompensationEvent": "Events", "EndSignalEvent": "Events",
    "EndMultipleEvent": "Events", "EndTerminateEvent": "Events",
    "SequenceFlow": "Sequence Flows",
    "Association_Undirected": "Associations", "Association_Unidirectional": "Associations",
    "Association_Bidirectional": "Associations",
    "MessageFlow": "Message Flows",
}
# Gateway stencil -> gateway type.
GATEWAY_TYPE = {"InclusiveGateway": "Inclusive", "Exclusive_Databased_Gateway": "Exclusive",
                "ParallelGateway": "Parallel", "EventbasedGateway": "Eventbased",
                "ComplexGateway": "Complex"}
# List order used for flow sources and lane references.
LIST_ORDER = ["tasks", "events", "gateways", "pools", "messageFlows", "sequenceFlows"]
CATEGORY_LIST = {"Activities": "tasks", "Events": "events", "Gateways": "gateways", "Pools": "pools",
                 "Sequence Flows": "sequenceFlows", "Message Flows": "messageFlows"}

def stencil_map(spark: SparkSession) -> DataFrame:
    rows = list(STENCIL_CATEGORY.items())
    return spark.createDataFrame(rows, "stencil string, category string")


def _lookup(stencil: str) -> str:
    """SQL of the category of a stencil; the fixed map as a literal: a lookup, not a join."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in STENCIL_CATEGORY.items())
    return f"element_at(map({pairs}), {stencil})"


# children of the diagram and of pools (their lanes), and of lanes that sit in
# a pool; other children are counted but not kept
_FLATTEN = f"""
WITH RECURSIVE shape(diagram_id, pos, parent_category, parent_lane, stencil, category, v) AS (
    SELECT diagram_id, CAST(array() AS ARRAY<INT>), CAST(NULL AS STRING), CAST(NULL AS STRING), stencil, {_lookup("stencil")}, v
    FROM (SELECT diagram_id, try_variant_get(v, '$.stencil.id', 'string') AS stencil, v
          FROM (SELECT diagram_id, try_parse_json(json) AS v FROM {{diagrams}}))
  UNION ALL
    SELECT diagram_id, pos, parent_category, parent_lane, stencil, {_lookup("stencil")}, v
    FROM (SELECT s.diagram_id, concat(s.pos, array(c.pos)) AS pos, s.category AS parent_category,
                 CASE WHEN s.category = 'Lanes' THEN try_variant_get(s.v, '$.resourceId', 'string') END AS parent_lane,
                 try_variant_get(c.value, '$.stencil.id', 'string') AS stencil, c.value AS v
          FROM shape s, LATERAL variant_explode(try_variant_get(s.v, '$.childShapes', 'variant')) c
          WHERE (s.category IN ('Diagram', 'Pools') OR (s.category = 'Lanes' AND s.parent_category = 'Pools')) AND c.key IS NULL)
)
SELECT diagram_id, pos, size(pos) AS depth, parent_category, parent_lane, stencil, category,
       try_variant_get(v, '$.resourceId', 'string') AS resourceId,
       try_variant_get(v, '$.properties.name', 'string') AS name_raw,
       try_variant_get(v, '$.properties.tasktype', 'string') AS tasktype,
       coalesce(transform(try_variant_get(v, '$.outgoing', 'array<struct<resourceId: string>>'), o -> o.resourceId), CAST(array() AS ARRAY<STRING>)) AS outgoing,
       try_variant_get(v, '$.target.resourceId', 'string') AS target,
       coalesce(size(try_variant_get(v, '$.childShapes', 'array<variant>')), 0) AS n_children
FROM shape"""


def flatten_shapes(diagrams: DataFrame, id_col: str = "diagram_id", json_col: str = "json", keep: bool = True) -> DataFrame:
    """B1/B2: every shape reached by the flattener, one row each:
    (diagram_id, pos array<int>, depth, parent_category, parent_lane, resourceId,
    stencil, category, name_raw, tasktype, outgoing array<string>, target,
    n_children).

    One plan for any depth of nesting; text that is no JSON gives one row
    without a stencil.  The query runs again for every branch of a plan that
    reads it, so with ``keep`` its result is written once to the checkpoint
    folder; without it nothing runs before the action.  The session's limits
    of recursion depth and rows are lifted: every level is whole."""
    spark = diagrams.sparkSession
    for limit in ("Level", "Row"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", "-1")
    shapes = spark.sql(_FLATTEN, diagrams=diagrams.select(F.col(id_col).alias("diagram_id"), F.col(json_col).alias("json")))
    return cut_lineage(shapes) if keep else shapes


def elements(shapes: DataFrame) -> DataFrame:
    """The element table (diagram_id, list, pos, id, name, type,
    parent_lane, outgoing, targetRef, condition) of the handled categories.

    Shapes under a lane that is not inside a pool are never reached; lanes
    themselves are returned by ``lanes``."""
    lst = F.create_map(*[x for kv in CATEGORY_LIST.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("category")]
    name = strip(F.regexp_replace(F.coalesce("name_raw", F.lit("")), "\n", " "))
    tt = F.col("tasktype")
    task_type = F.when(tt.isNull() | (tt == "None") | (tt == ""), F.col("stencil")).otherwise(tt)
    gw = F.create_map(*[x for kv in GATEWAY_TYPE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("stencil")]
    gw_type = F.coalesce(gw, F.col("stencil"))
    cat = F.col("category")
    typ = (F.when(cat == "Events", F.col("stencil")).when(cat == "Activities", task_type)
           .when(cat == "Gateways", gw_type))
    is_flow = cat.isin("Sequence Flows", "Message Flows")
    nm = F.when(is_flow, F.lit(None)).when((cat == "Gateways") & (name == ""), F.lit(None)).otherwise(name)
    valid_parent = F.col("parent_category").isNull() | F.col("parent_category").isin("Diagram", "Lanes")
    sh = shapes.where(lst.isNotNull() & valid_parent)
    return sh.select(
        "diagram_id", lst.alias("list"), "pos", F.col("resourceId").alias("id"), nm.alias("name"),
        typ.alias("type"), F.coalesce("parent_lane", F.lit("")).alias("parent_lane"), "outgoing",
        F.when(is_flow, F.col("target")).alias("targetRef"),
        F.when(is_flow & (name != ""), name).alias("condition"))


def lanes(shapes: DataFrame) -> DataFrame:
    """Lanes of pools: (diagram_id, pool_id, lane_pos, lane_id, lane_name)."""
    ln = shapes.where((F.col("category") == "Lanes") & (F.col("parent_category") == "Pools"))
    pool_pos = F.slice("pos", 1, F.size("pos") - 1)
    pools = shapes.where(F.col("category") == "Pools").select(
        "diagram_id", F.col("pos").alias("_pp"), F.col("resourceId").alias("pool_id"))
    return (ln.withColumn("_pp", pool_pos).join(pools, ["diagram_id", "_pp"])
            .select("diagram_id", "pool_id", F.col("pos").alias("lane_pos"), F.col("resourceId").alias("lane_id"),
                    strip(F.coalesce("name_raw", F.lit(""))).alias("lane_name")))


def _rank():
    r = None
    for i, n in enumerate(LIST_ORDER):
        r = F.when(F.col("list") == n, i) if r is None else r.when(F.col("list") == n, i)
    return r


def flow_sources(els: DataFrame) -> DataFrame:
    """(diagram_id, flow id, sourceRef) -- the element whose outgoing lists
    the flow; with several, the last in list order wins."""
    out = els.select("diagram_id", F.col("id").alias("item"), _rank().alias("_r"), "pos",
                     F.explode("outgoing").alias("fid"))
    return (out.groupBy("diagram_id", "fid")
            .agg(F.max_by("item", F.struct("_r", "pos")).alias("sourceRef")))


def lane_refs(els: DataFrame) -> DataFrame:
    """(diagram_id, lane_id, ref_pos, ref_id) in list order, then position."""
    x = els.where(F.col("parent_lane") != "")
    return x.select("diagram_id", F.col("parent_lane").alias("lane_id"),
                    F.struct(_rank().alias("r"), F.col("pos").alias("p")).alias("ref_pos"),
                    F.col("id").alias("ref_id"))


def violations(shapes: DataFrame) -> DataFrame:
    """Structural findings (diagram_id, id, problem): a leaf with
    children, a pool child that is not a lane, a lane with outgoing flows, an
    unknown stencil."""
    leaf = F.col("category").isin("Events", "Activities", "Gateways", "Sequence Flows", "Message Flows")
    return (shapes.select(
        "diagram_id", F.col("resourceId").alias("id"),
        F.when(F.col("category").isNull(), "unknown stencil")
         .when(leaf & (F.col("n_children") > 0), "leaf with children")
         .when((F.col("parent_category") == "Pools") & (F.col("category") != "Lanes"), "pool child not a lane")
         .when((F.col("category") == "Lanes") & (F.col("parent_category") == "Pools")
               & (F.size("outgoing") > 0), "lane with outgoing").alias("problem"))
        .where(F.col("problem").isNotNull()))


def transform(shapes: DataFrame) -> dict[str, DataFrame]:
    """The six-list object in long form, ready for labels and scoring:
    elements (with resolved flow sources), lanes, lane_refs."""
    els = elements(shapes)
    src = flow_sources(els)
    flows = (els.where(F.col("list").isin("sequenceFlows", "messageFlows"))
             .join(src.withColumnRenamed("fid", "id"), ["diagram_id", "id"], "left"))
    return {"elements": els.where(F.col("list").isin("tasks", "events", "gateways", "pools")),
            "flows": flows.select("diagram_id", "list", "pos", "id", "sourceRef", "targetRef", "condition"),
            "lanes": lanes(shapes), "lane_refs": lane_refs(els)}


def to_json(tr: dict[str, DataFrame], diagrams: DataFrame) -> DataFrame:
    """(diagram_id, json) with the six lists; lanes carry elemRefs."""
    els, flows, ln, refs = tr["elements"], tr["flows"], tr["lanes"], tr["lane_refs"]
    def lst(df, name, fields):
        return (df.where(F.col("list") == name).groupBy("diagram_id")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))),
                                 lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name)))
    lr = (refs.groupBy("diagram_id", "lane_id")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "ref_id"))),
                           lambda x: x["ref_id"]).alias("elemRefs")))
    lanes_ = (ln.join(lr, ["diagram_id", "lane_id"], "left")
              .groupBy("diagram_id", "pool_id")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("lane_pos", "lane_id", "lane_name", "elemRefs"))),
                               lambda x: F.struct(x["lane_id"].alias("id"), x["lane_name"].alias("name"),
                                                  F.coalesce(x["elemRefs"], F.array().cast("array<string>"))
                                                  .alias("elemRefs"))).alias("lanes")))
    pools = els.where(F.col("list") == "pools").join(
        lanes_.withColumnRenamed("pool_id", "id"), ["diagram_id", "id"], "left")
    pools = pools.withColumn("lanes", F.coalesce("lanes", F.array().cast(pools.schema["lanes"].dataType)))
    # a message flow's text is its label, a sequence flow's its condition
    flows = flows.withColumn("label", F.col("condition"))
    parts = {"tasks": lst(els, "tasks", ["id", "name", "type"]), "events": lst(els, "events", ["id", "name", "type"]),
             "gateways": lst(els, "gateways", ["id", "name", "type"]), "pools": lst(pools, "pools", ["id", "name", "lanes"]),
             "sequenceFlows": lst(flows, "sequenceFlows", ["id", "sourceRef", "targetRef", "condition"]),
             "messageFlows": lst(flows, "messageFlows", ["id", "sourceRef", "targetRef", "label"])}
    d = diagrams.select("diagram_id")
    for p in parts.values():
        d = d.join(p, "diagram_id", "left")
    six = [F.coalesce(n, F.array().cast(p.schema[n].dataType)).alias(n) for n, p in parts.items()]
    return d.select("diagram_id", F.to_json(F.struct(*six)).alias("json"))


def scorable_flags(diagrams: DataFrame, shapes: DataFrame, tr: dict[str, DataFrame]) -> DataFrame:
    """(model_id, scorable) of every diagram: one with a structural
    finding, or a flow whose source no element names, can not be scored."""
    bad = violations(shapes).select("diagram_id").unionByName(
        tr["flows"].where(F.col("sourceRef").isNull()).select("diagram_id")).distinct()
    d = diagrams.select("diagram_id").join(bad.withColumn("_bad", F.lit(True)), "diagram_id", "left")
    return d.select(F.col("diagram_id").alias("model_id"), F.col("_bad").isNull().alias("scorable"))
