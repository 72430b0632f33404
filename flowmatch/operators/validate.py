"""Model text validation as rule rows (V1-V13) and schema checks.

``validate_lines`` turns (model_id, line_no, line) into one row per finding
(model_id, line_no, tok_no, rule, node_id, message); ``validation_status``
folds them into (model_id, status, n_errors, errors).  The stateful
first-legal-label rule (V4-V6) is an aggregate per (model, node id) joined
back, not a per-model loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmatch.functions.text import ARROW, strip

# The validator's messages and patterns.
MSG_FEW_NODES = "There are less nodes than allowed in line #{}"
MSG_STRUCTURE = "There is a node than violate predefined structure in line #{}"
MSG_MULTI_LABEL = "Node #{} has multiple labels"
MSG_NO_LABEL = "Node #{} has no label"
MSG_RULES = "Node #{} violates the predefined rules"
MSG_TYPE = "Type of node #{} is not coresponding to the predefined format."
MSG_SYNTAX = "The syntax of node #{} is not coresponding to the predefined format."
MSG_NODETYPE = "Nodetype {} is not defined"
MSG_MULTI_START = "There are multiple start events in the model."
NODE_RE = "(?U)^(\\S+):(\\S+):(.*$)"
END_LABEL_RE = "\\((.*?)\\)$"
EVENT_TEXT_RE = "^\\(\\(.*?\\)\\)$"
GATEWAY_TEXT_RE = "^\\{.*?\\}$"


def _f(rule: str, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), message.alias("message"))


def _fmt(template: str, arg: Column) -> Column:
    a, b = template.split("{}")
    return F.concat(F.lit(a), arg.cast("string"), F.lit(b))


def validate_lines(lns: DataFrame) -> DataFrame:
    """Rule rows for every model line.

    One pass over the lines (V1), one over the tokens (V2-V11, at most two
    findings per token: a broken id plus one type / label finding) and one
    aggregate (V12)."""
    keep = lns.where((F.col("line") != "") & ~F.col("line").contains("graph")
                     & ~F.col("line").contains("flowchart"))
    parts = F.split(F.col("line"), ARROW, -1)
    v1 = keep.where(F.size(parts) <= 1).select(
        "model_id", "line_no", F.lit(-1).alias("tok_no"), F.lit(0).alias("seq"), F.lit("V1").alias("rule"),
        F.lit(None).cast("string").alias("node_id"), _fmt(MSG_FEW_NODES, F.col("line_no")).alias("message"))
    t = (keep.where(F.size(parts) > 1)
         .select("model_id", "line_no", F.posexplode(parts).alias("tok_no", "tok")))
    p = F.split(F.col("tok"), ":", -1)
    raw_id = strip(p[0])
    digits = F.regexp_extract(raw_id, "(?U)(\\d+)$", 1)
    text = strip(p[2])
    text = F.when(text.contains("--"), strip(F.split(text, "--", -1)[0])).otherwise(text)
    node = (F.size(p) > 1) & F.col("tok").rlike(NODE_RE)
    n = t.select("model_id", "line_no", "tok_no", "tok",
                 (F.size(p) <= 1).alias("no_colon"), node.alias("is_node"),
                 F.when(node, F.when(raw_id.contains("|") & (digits != ""), digits).otherwise(raw_id))
                  .alias("node_id"),
                 (node & raw_id.contains("|") & (digits == "")).alias("bad_id"),
                 F.when(node, strip(p[1])).alias("node_type"), F.when(node, text).alias("node_text"),
                 F.when(node, F.regexp_extract(F.col("tok"), END_LABEL_RE, 1)).alias("label"))
    ty = F.col("node_type")
    is_task = F.col("is_node") & ty.contains("task")
    is_event = F.col("is_node") & ~ty.contains("task") & ty.contains("event")
    is_gw = F.col("is_node") & ~ty.contains("task") & ~ty.contains("event") & ty.contains("gateway")
    has_label = is_task & (F.col("label") != "")
    legal = ~F.col("label").rlike("[(|)]+")
    pos = F.struct("line_no", "tok_no")
    # V4-V6: the first label without ( | ) characters is the node's label.
    first = (n.where(has_label & legal).groupBy("model_id", "node_id")
             .agg(F.min(pos).alias("first_pos"), F.min_by("label", pos).alias("first_label")))
    n = n.join(first, ["model_id", "node_id"], "left")
    before = F.col("first_pos").isNull() | (pos < F.col("first_pos"))
    after = F.col("first_pos").isNotNull() & (pos > F.col("first_pos"))
    letters = F.col("label").rlike("[a-zA-Z]")
    start_end = ty.contains("start") | ty.contains("end")
    xp = ty.contains("exclusive") | ty.contains("parallel")
    nid = F.col("node_id")
    main = (F.when(F.col("no_colon"), _f("V2", _fmt(MSG_STRUCTURE, F.col("line_no"))))
            .when(has_label & before, _f("V6", _fmt(MSG_RULES, nid)))
            .when(has_label & after & letters & (F.col("label") != F.col("first_label")),
                  _f("V4", _fmt(MSG_MULTI_LABEL, nid)))
            .when(has_label & after & ~letters, _f("V5", _fmt(MSG_NO_LABEL, nid)))
            .when(is_event & ~start_end, _f("V7", _fmt(MSG_TYPE, nid)))
            .when(is_event & ~F.col("node_text").rlike(EVENT_TEXT_RE), _f("V8", _fmt(MSG_SYNTAX, nid)))
            .when(is_gw & ~xp, _f("V9", _fmt(MSG_TYPE, nid)))
            .when(is_gw & (F.col("node_text") != "") & ~F.col("node_text").rlike(GATEWAY_TEXT_RE),
                  _f("V10", _fmt(MSG_SYNTAX, nid)))
            .when(F.col("is_node") & ~is_task & ~is_event & ~is_gw,
                  _f("V11", _fmt(MSG_NODETYPE, ty))))
    broken = F.when(F.col("bad_id"), _f("V3", _fmt(MSG_STRUCTURE, F.col("line_no"))))
    found = F.filter(F.array(broken, main), lambda x: x.isNotNull())
    tok_rows = (n.select("model_id", "line_no", "tok_no", "node_id", F.posexplode(found).alias("seq", "f"))
                .select("model_id", "line_no", "tok_no", "seq", F.col("f")["rule"].alias("rule"),
                        F.when(F.col("f")["rule"] != "V2", F.col("node_id")).alias("node_id"),
                        F.col("f")["message"].alias("message")))
    starts = (n.where(is_event & ty.contains("start")).groupBy("model_id")
              .agg(F.count_distinct("node_id").alias("n_start"), F.max("line_no").alias("line_no")))
    v12 = starts.where(F.col("n_start") > 1).select(
        "model_id", "line_no", F.lit(1 << 30).alias("tok_no"), F.lit(0).alias("seq"), F.lit("V12").alias("rule"),
        F.lit(None).cast("string").alias("node_id"), F.lit(MSG_MULTI_START).alias("message"))
    return v1.unionByName(tok_rows).unionByName(v12)


def validation_status(models: DataFrame, findings: DataFrame) -> DataFrame:
    """(model_id, status 1/0, n_errors, errors): the errors in order of
    line, token and rule, the one about the whole model (V12) last."""
    agg = findings.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_errors"),
        F.transform(F.array_sort(F.collect_list(F.struct((F.col("rule") == "V12").alias("last"), "line_no", "tok_no",
                                                         "seq", "message"))),
                    lambda x: x["message"]).alias("errors"))
    m = models.select("model_id").join(agg, "model_id", "left")
    return m.select("model_id",
                    F.when(F.col("n_errors").isNull(), 1).otherwise(0).alias("status"),
                    F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
                    F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


# The enumerations of the simplified process schema.
TASK_TYPES = ["Task", "Manual", "CollapsedSubprocess", "Service", "User", "Send", "Business Rule",
              "Receive", "Script", "CollapsedEventSubprocess"]
EVENT_TYPES = ["StartNoneEvent", "EndNoneEvent", "IntermediateMessageEventCatching",
               "IntermediateTimerEvent", "StartMessageEvent", "IntermediateMessageEventThrowing",
               "EndMessageEvent", "IntermediateConditionalEvent", "IntermediateEscalationEvent",
               "IntermediateErrorEvent", "EndEscalationEvent", "EndCancelEvent",
               "IntermediateMultipleEventThrowing", "IntermediateLinkEventThrowing", "StartTimerEvent",
               "IntermediateCancelEvent", "IntermediateLinkEventCatching"]
GATEWAY_TYPES = ["Exclusive", "Parallel", "Eventbased", "Inclusive", "Complex"]
REQUIRED = {"tasks": ["id", "name", "type"], "events": ["id", "name", "type"],
            "gateways": ["id", "type"], "pools": ["id", "name"]}
FLOW_REQUIRED = ["id", "sourceRef", "targetRef"]
TOP_LEVEL = ["tasks", "events", "gateways", "pools", "sequenceFlows", "messageFlows"]


def schema_violations(els: DataFrame, flw: DataFrame | None = None) -> DataFrame:
    """(model_id, list, id, field, problem) for missing required fields
    and type values outside the schema's enumerations, in one pass over the
    elements.  A ``lanes`` column, where there is one, must be set on pools."""
    enums = {"tasks": TASK_TYPES, "events": EVENT_TYPES, "gateways": GATEWAY_TYPES}

    def findings(df, checks):
        found = F.filter(F.array(*[
            F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))
            for cond, field, problem in checks]), lambda x: x.isNotNull())
        return df.select("model_id", "list", "id", F.inline(found))

    checks = []
    for lst, fields in REQUIRED.items():
        here = F.col("list") == lst
        checks += [(here & F.col(f).isNull(), f, "missing") for f in fields]
        if lst in enums:
            checks.append((here & F.col("type").isNotNull() & ~F.col("type").isin(*enums[lst]), "type", "not in enum"))
    if "lanes" in els.columns:
        checks.append(((F.col("list") == "pools") & F.col("lanes").isNull(), "lanes", "missing"))
    out = findings(els, checks)
    if flw is not None:
        out = out.unionByName(findings(flw, [(F.col(f).isNull(), f, "missing") for f in FLOW_REQUIRED]))
    return out


def missing_lists(models: DataFrame, json_col: str = "json") -> DataFrame:
    """(model_id, field) for each of the six top-level lists that a
    model's JSON object lacks; text that is no object lacks all."""
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in TOP_LEVEL])
    return models.select("model_id", F.explode(F.array_except(want, keys)).alias("field"))
