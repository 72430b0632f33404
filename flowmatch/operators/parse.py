"""Model text -> node and flow tables, and back.

Grammar: a header line (``flowchart LR`` / ``graph LR``), then lines of
``id:type:shape-->[|label|]id:type:shape``.  Every operator here is a
built-in expression pipeline: ``split`` / ``posexplode`` for lines and
tokens, ``regexp_extract`` for ids and labels, aggregates for de-duplication.

Parsing rules (the converter's, kept deliberately):

* a token without ``:`` yields nothing (headers, fences, bare ``0-->1``);
* the first two tokens of a line set the flow's source and target; later
  tokens add nodes but no flow (an option, ``chain``, gives them flows); a line with any ``:`` token makes a flow,
  even with only one endpoint (such a model is *unscorable*);
* kind by substring of the type: task, else event, else gateway, else the
  node is dropped (subprocess) while its flows stay;
* a task registers only with a non-empty ``( ... )`` text; per (kind, id)
  the position is the first registering mention, the text the last one;
* an id containing ``|`` (edge label) is repaired to its trailing digits;
  when there are none the id is NULL and the model unscorable;
* events are ``start`` / ``end`` by substring of the type; any other event
  type makes the model unscorable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.functions.text import (ARROW, LINE_BREAKS, TRAILING_DIGITS_RE, first_label,
                                      nonempty, strip)
from flowmatch.session import dealt

# Normalised element types.
TASK_TYPE = "User"
START, END = ("start", "StartNoneEvent"), ("end", "EndNoneEvent")
GATEWAY_TYPES = ("Exclusive", "Parallel", "UNDEFINED")


def lines(models: DataFrame, model_col: str = "model_id", text_col: str = "text") -> DataFrame:
    """(model_id, line_no, line) -- every line of every whole text."""
    texts = dealt(models.select(F.col(model_col).alias("model_id"), F.col(text_col).alias("text")), "model_id")
    return texts.select("model_id", F.posexplode(F.split(F.col("text"), LINE_BREAKS, -1)).alias("line_no", "line"))


def _node_id(raw):
    """The id of a token whose stripped first field is ``raw`` (a column, as it is read more than once)."""
    fixed = nonempty(F.regexp_extract(raw, TRAILING_DIGITS_RE, 1))
    return F.when(raw.contains("|"), fixed).otherwise(raw)


def _made(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The ``kept`` columns and the ``made`` ones, as the output of a generator:
    a filter on these reads them, where it would else be moved below and
    work out all their patterns once more."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def tokens(lns: DataFrame) -> DataFrame:
    """Node tokens with ``:`` -> (model_id, line_no, tok_no, tok, node_id,
    node_type, kind, id_broken)."""
    t = lns.select("model_id", "line_no",
                   F.posexplode(F.split(F.col("line"), ARROW, -1)).alias("tok_no", "tok"))
    t = t.where(F.col("tok").contains(":"))
    t = t.withColumn("p", F.split(F.col("tok"), ":", -1))
    t = t.select("model_id", "line_no", "tok_no", "tok", strip(F.col("p")[0]).alias("raw"), strip(F.col("p")[1]).alias("node_type"))
    kind = (F.when(F.col("node_type").contains("task"), "task")
            .when(F.col("node_type").contains("event"), "event")
            .when(F.col("node_type").contains("gateway"), "gateway"))
    t = _made(t, "model_id", "line_no", "tok_no", "tok", node_id=_node_id(F.col("raw")), node_type=F.col("node_type"), kind=kind)
    return t.withColumn("id_broken", F.col("node_id").isNull())


def nodes(toks: DataFrame) -> DataFrame:
    """One row per (model_id, kind, node_id): first position, last text.

    ``value`` is the task label or the raw event / gateway type.
    """
    value = F.when(F.col("kind") == "task", first_label(F.col("tok"))).otherwise(F.col("node_type"))
    reg = toks.where(F.col("kind").isNotNull() & F.col("node_id").isNotNull())
    reg = (_made(reg, "model_id", "kind", "node_id", value=value, pos=F.struct("line_no", "tok_no"))
           .where((F.col("kind") != "task") | F.col("value").isNotNull()))
    return (reg.groupBy("model_id", "kind", "node_id")
            .agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value")))


def flows(lns: DataFrame, number: bool = True, chain: bool = False) -> DataFrame:
    """One flow per line holding any ``:`` token, numbered ``sf0, sf1, ...``
    over those lines.  Source = token 0, target = token 1 (when they hold ``:``).

    With ``chain`` a line of more than two tokens, ``a-->b-->c``, gives a flow
    for each two neighbours of which one holds ``:``; other lines are as
    without it.  ``step`` is the flow's place in its line.

    Numbering is a window per model; a model parsed from one text is one row
    already, so the window never gathers more than a text.  ``number=False``
    keeps only ``line_no`` (and ``step``) as the flow order (for line tables of
    any size)."""
    toks = F.split(F.col("line"), ARROW, -1)
    rows = lns.where(F.exists(toks, lambda x: x.contains(":")))
    if chain:
        step = lambda i: F.struct(F.get(toks, i).alias("t0"), F.get(toks, i + 1).alias("t1"))
        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.size(toks) - 2, F.lit(0))), step)
        rows = rows.select("model_id", "line_no", F.size(toks).alias("n"), F.posexplode(steps).alias("step", "p"))
        rows = rows.select("model_id", "line_no", "step", "n", "p.t0", "p.t1").where((F.col("n") <= 2) | F.col("t0").contains(":") | F.col("t1").contains(":"))
    else:
        rows = rows.select("model_id", "line_no", toks[0].alias("t0"), F.get(toks, F.lit(1)).alias("t1"))
    t0, t1 = F.col("t0"), F.col("t1")
    kept = ["model_id", "line_no", *(["step"] if chain else [])]
    rows = rows.select(*kept, t0.contains(":").alias("is0"), t1.contains(":").alias("is1"),
                       F.split(t0, ":", -1)[0].alias("f0"), F.split(t1, ":", -1)[0].alias("f1"))
    rows = rows.withColumns({"raw0": strip(F.col("f0")), "raw1": strip(F.col("f1"))})
    rows = rows.withColumns({"id0": _node_id(F.col("raw0")), "id1": _node_id(F.col("raw1"))})
    f = _made(rows, *kept, sourceRef=F.when(F.col("is0"), F.col("id0")), targetRef=F.when(F.col("is1"), F.col("id1")),
              edge_label=nonempty(F.regexp_extract("f1", "\\|(.*)\\|", 1)),
              src_broken=F.col("is0") & F.col("id0").isNull(), dst_broken=F.col("is1") & F.col("id1").isNull())
    if not number:
        return f
    w = Window.partitionBy("model_id").orderBy("line_no", *(["step"] if chain else []))
    f = f.withColumn("edge_no", F.row_number().over(w) - 1)
    return f.withColumn("id", F.concat(F.lit("sf"), F.col("edge_no").cast("string")))


def elements(nds: DataFrame, fix_inclusive: bool = False) -> DataFrame:
    """Normalised element table (model_id, list, pos, id, name, type, valid).

    Tasks: name = label, type User.  Events: start / end by type substring
    (``valid`` false otherwise).  Gateways: no name; Exclusive / Parallel /
    UNDEFINED (Inclusive with ``fix_inclusive``).
    """
    v = F.col("value")
    ev_name = F.when(v.contains("start"), START[0]).when(v.contains("end"), END[0])
    ev_type = F.when(v.contains("start"), START[1]).when(v.contains("end"), END[1])
    gw = F.when(v.contains("exclusive"), "Exclusive").when(v.contains("parallel"), "Parallel")
    if fix_inclusive:
        gw = gw.when(v.contains("inclusive"), "Inclusive")
    gw = gw.otherwise("UNDEFINED")
    k = F.col("kind")
    return nds.select(
        "model_id",
        F.when(k == "task", "tasks").when(k == "event", "events").otherwise("gateways").alias("list"),
        "pos", F.col("node_id").alias("id"),
        F.when(k == "task", v).when(k == "event", ev_name).alias("name"),
        F.when(k == "task", F.lit(TASK_TYPE)).when(k == "event", ev_type).otherwise(gw).alias("type"),
        F.when(k == "event", ev_type.isNotNull()).otherwise(F.lit(True)).alias("valid"))


def model_flags(models: DataFrame, els: DataFrame, flw: DataFrame, toks: DataFrame) -> DataFrame:
    """(model_id, scorable): false when a flow lacks an endpoint, an id is
    broken, or an event is neither start nor end."""
    bad_flow = (flw.where(F.col("sourceRef").isNull() | F.col("targetRef").isNull()
                          | F.col("src_broken") | F.col("dst_broken"))
                .select("model_id"))
    bad_el = els.where(~F.col("valid")).select("model_id")
    bad_tok = toks.where(F.col("id_broken")).select("model_id")
    bad = bad_flow.unionByName(bad_el).unionByName(bad_tok).distinct().withColumn("_bad", F.lit(True))
    return (models.select("model_id").join(bad, "model_id", "left")
            .select("model_id", F.col("_bad").isNull().alias("scorable")))


def parse_models(models: DataFrame, model_col: str = "model_id", text_col: str = "text",
                 fix_inclusive: bool = False, chain: bool = False) -> dict[str, DataFrame]:
    """Text -> {'lines', 'tokens', 'nodes', 'elements', 'flows', 'flags'}."""
    lns = lines(models, model_col, text_col)
    return parse_lines(lns, models.select(F.col(model_col).alias("model_id")), fix_inclusive, chain=chain)


def parse_lines(lns: DataFrame, models: DataFrame, fix_inclusive: bool = False,
                number: bool = True, chain: bool = False) -> dict[str, DataFrame]:
    """(model_id, line_no, line) -> parsed tables; ``models`` lists every model_id."""
    toks = tokens(lns)
    nds = nodes(toks)
    els = elements(nds, fix_inclusive)
    flw = flows(lns, number, chain)
    flags = model_flags(models, els, flw, toks)
    return {"lines": lns, "tokens": toks, "nodes": nds, "elements": els, "flows": flw,
            "flags": flags}


def next_free_id(els: DataFrame) -> DataFrame:
    """Max numeric element id + 1 per model; NULL if an id is not an integer."""
    n = F.expr("try_cast(id AS BIGINT)")
    return (els.groupBy("model_id")
            .agg(F.when(F.count_if(n.isNull()) > 0, F.lit(None))
                 .otherwise(F.max(n) + 1).alias("next_id")))


def node_text(els: DataFrame) -> DataFrame:
    """Element -> grammar text ``id:type:shape``; unknown types skipped.

    When an id appears in several lists the later list wins (gateways over
    events over tasks), as a per-id map would keep.
    """
    t = F.lower(F.col("type"))
    l = F.col("list")
    txt = (F.when(l == "tasks", F.format_string("%s:task:(%s)", F.col("id"), F.col("name")))
           .when((l == "events") & t.contains("start"),
                 F.format_string("%s:startevent:((start event))", F.col("id")))
           .when((l == "events") & t.contains("end"),
                 F.format_string("%s:endevent:((end event))", F.col("id")))
           .when((l == "gateways") & t.contains("exclusive"),
                 F.format_string("%s:exclusivegateway:{x}", F.col("id")))
           .when((l == "gateways") & t.contains("parallel"),
                 F.format_string("%s:parallelgateway:{AND}", F.col("id")))
           .when((l == "gateways") & t.contains("inclusive"),
                 F.format_string("%s:inclusivegateway:{O}", F.col("id"))))
    rank = F.when(l == "tasks", 0).when(l == "events", 1).otherwise(2)
    return (els.where(txt.isNotNull())
            .groupBy("model_id", "id")
            .agg(F.max_by(txt, F.struct(rank, F.col("pos"))).alias("node_text")))


def edge_lines(els: DataFrame, flw: DataFrame) -> DataFrame:
    """(model_id, line_no, line, complete) with ``src --> dst`` texts.

    ``complete`` is false when an endpoint has no node text (the text writer
    of the reference raises there)."""
    nt = node_text(els)
    s = nt.select("model_id", F.col("id").alias("sourceRef"), F.col("node_text").alias("_s"))
    d = nt.select("model_id", F.col("id").alias("targetRef"), F.col("node_text").alias("_d"))
    e = (flw.select("model_id", "line_no", "sourceRef", "targetRef")
         .join(s, ["model_id", "sourceRef"], "left").join(d, ["model_id", "targetRef"], "left"))
    return e.select("model_id", "line_no",
                    F.concat_ws(" --> ", "_s", "_d").alias("line"),
                    (F.col("_s").isNotNull() & F.col("_d").isNotNull()).alias("complete"))


def model_text(els: DataFrame, flw: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(model_id, text, complete): ``graph LR`` header and one line per flow.

    One string per model; its size is bounded by the model it came from.
    """
    el = edge_lines(els, flw)
    agg = el.groupBy("model_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                 lambda x: x["line"]), "\n").alias("_body"),
        F.bool_and("complete").alias("complete"))
    if models is not None:
        agg = models.select("model_id").join(agg, "model_id", "left")
    return agg.select("model_id",
                      F.concat(F.lit("graph LR\n"), F.coalesce(F.col("_body"), F.lit(""))).alias("text"),
                      F.coalesce(F.col("complete"), F.lit(True)).alias("complete"))


def model_json(els: DataFrame, flw: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, json) of the six-list object; missing lists are []."""
    def lst(name, fields):
        items = F.collect_list(F.when(F.col("list") == name, F.struct("pos", *fields)))
        return F.transform(F.array_sort(items), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name)
    # the three lists in one pass over the elements; a model without items of a list has an empty one
    e = els.groupBy("model_id").agg(lst("tasks", ["id", "name", "type"]), lst("events", ["id", "name", "type"]),
                                    lst("gateways", ["id", "type"]))
    sf = (flw.groupBy("model_id")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_no", "id", "sourceRef", "targetRef"))),
                           lambda x: F.struct(x["id"].alias("id"), x["sourceRef"].alias("sourceRef"),
                                              x["targetRef"].alias("targetRef"))).alias("sequenceFlows")))
    m = models.select("model_id").join(e, "model_id", "left").join(sf, "model_id", "left")
    empty = F.array().cast("array<string>")
    obj = F.struct(
        F.coalesce("tasks", F.array().cast(e.schema["tasks"].dataType)).alias("tasks"),
        F.coalesce("events", F.array().cast(e.schema["events"].dataType)).alias("events"),
        F.coalesce("gateways", F.array().cast(e.schema["gateways"].dataType)).alias("gateways"),
        empty.alias("pools"),
        F.coalesce("sequenceFlows", F.array().cast(sf.schema["sequenceFlows"].dataType)).alias("sequenceFlows"),
        empty.alias("messageFlows"))
    return m.select("model_id", F.to_json(obj).alias("json"))


def task_labels(lns: DataFrame) -> DataFrame:
    """Unique task labels per model in first-seen order.

    Here ``task`` is looked for in the whole token, not the type field.
    Returns (model_id, label, first_pos)."""
    t = (lns.select("model_id", "line_no",
                    F.posexplode(F.split(F.col("line"), ARROW, -1)).alias("tok_no", "tok"))
         .where(F.col("tok").contains("task")))
    t = t.select("model_id", first_label(F.col("tok")).alias("label"),
                 F.struct("line_no", "tok_no").alias("pos")).where(F.col("label").isNotNull())
    return t.groupBy("model_id", "label").agg(F.min("pos").alias("first_pos"))


def task_info(labels: DataFrame) -> DataFrame:
    """(model_id, json) of ``{"tasks": sorted labels, "number": n}``."""
    return (labels.groupBy("model_id")
            .agg(F.array_sort(F.collect_list("label")).alias("tasks"))
            .select("model_id", F.to_json(F.struct("tasks", F.size("tasks").alias("number"))).alias("json"),
                    F.size("tasks").alias("number")))


def compare_tasks(t1: DataFrame, t2: DataFrame, keys: list[str]) -> DataFrame:
    """Exact task comparison of two ordered task lists per key.

    ``t1``/``t2``: (keys..., pos, task).  Match key = lower case without
    spaces.  Returns (keys..., side, pos, task, status) with status ``ident``
    (in list 1 and matched), ``not_ident1`` or ``not_ident2``; duplicates kept.
    """
    nk = F.lower(F.regexp_replace(F.col("task"), " ", ""))
    both = t1.withColumns({"_k": nk, "_side": F.lit(1)}).unionByName(t2.withColumns({"_k": nk, "_side": F.lit(2)}))
    # one exchange: which sides a match key occurs on
    w = Window.partitionBy(*keys, "_k")
    both = both.withColumns({"_lo": F.min("_side").over(w), "_hi": F.max("_side").over(w)})
    status = (F.when((F.col("_side") == 1) & (F.col("_hi") == 2), "ident").when(F.col("_side") == 1, "not_ident1")
              .when(F.col("_lo") == 2, "not_ident2"))
    return (both.withColumn("status", status).where(F.col("status").isNotNull())
            .drop("_k", "_side", "_lo", "_hi"))


# The six lists every process object must carry.
REQUIRED_KEYS = ["tasks", "events", "gateways", "pools", "sequenceFlows", "messageFlows"]


def repair_json(df: DataFrame, col: str) -> DataFrame:
    """Cut generated text to its first ``{`` .. last ``}``, parse it,
    and add the required lists that are missing as ``[]``.

    Adds ``json`` (the completed object, NULL on error), ``error`` and
    ``added_keys``.  A repeated key is no error (a reader takes the last)."""
    js = F.regexp_extract(F.col(col), "(?s)(\\{.*\\})", 1)
    d = df.withColumn("_js", js)
    # one JSON value and nothing after it: the list of it has one item
    items = F.from_json(F.concat(F.lit("["), F.col("_js"), F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    ok = (F.col("_js") != "") & F.coalesce(F.size(items) == 1, F.lit(False)) & F.json_object_keys("_js").isNotNull()
    d = d.withColumn("_ok", ok).withColumn("_keys", F.when(F.col("_ok"), F.json_object_keys("_js")))
    d = d.withColumn("_add", F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.col("_keys")))
    added = F.array_join(F.transform("_add", lambda k: F.concat(F.lit('"'), k, F.lit('": []'))), ", ")
    comma = F.when((F.size("_keys") > 0) & (F.size("_add") > 0), ", ").otherwise("")
    whole = F.concat(F.regexp_replace("_js", r"\s*\}$", ""), comma, added, F.lit("}"))
    return (d.withColumn("error", ~F.col("_ok"))
            .withColumn("json", F.when(F.col("_ok"), whole))
            .withColumn("added_keys", F.when(F.col("_ok"), F.size("_add")))
            .drop("_js", "_ok", "_keys", "_add"))
