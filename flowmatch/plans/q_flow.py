"""Pipeline-stage queries: reshape, lookups, flags, gates, batch scoring,
outcome summaries and batch generation (W1-W13, M7, M8, A1-A6, T1-T4).

Test-table stand-ins: conversation user turns are survey wordings (turn =
pattern column, conversation = respondent); documents with their labels are
derive / compare rows (source = provider, lang = pattern, quality = mapping,
toxic = not epap); weekly traces are candidate models and each pattern's
expected model is a trace.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmatch.operators import batch as B
from flowmatch.operators import generate as G
from flowmatch.operators import outcome as A
from flowmatch.operators import reshape as R
from flowmatch.operators import score as S
from flowmatch.plans import oracle as O
from flowmatch.plans import traces as T
from flowmatch.plans.q_match import doc_overlap
from flowmatch.plans.registry import register
from flowmatch.session import counted_broadcast, cut_lineage, dealt
from flowmatch.sources.tables import table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("pattern", F.concat(F.lit("T"), F.col("turn").cast("string")))


@register("q_wording_unpivot", """
SELECT conv_id, 'T' || CAST(turn AS VARCHAR) AS pattern, text FROM conversations
WHERE role = 'user' AND text IS NOT NULL AND trim(text) <> ''""")
def q_wording_unpivot(spark, sf_dir):
    """Wide sheet of user wordings -> (respondent, pattern, wording)."""
    wide = R.pivot_results(_turns(spark, sf_dir).where(F.col("role") == "user"), "conv_id", "pattern", "text")
    return R.unpivot_wordings(wide, ["conv_id"], wide.columns[2:]).drop("occurrence")


def _identified(spark, sf_dir):
    """User wordings with an expected pattern (by turn) and a returned id
    (by conversation and turn; index 18 is an id outside the rulebase)."""
    ids = [p for p, _, _ in R.RULEBASE]
    exp = F.element_at(F.array(*[F.lit(p) for p in ids]), (F.col("turn") % 18 + 1).cast("int"))
    res = F.element_at(F.array(*[F.lit(p) for p in ids + ["AP11"]]),
                       ((F.col("conv_id") + F.col("turn")) % 19 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", "text", exp.alias("pattern"), res.alias("result"))


_IDS_SQL = "[" + ", ".join(f"'{p}'" for p, _, _ in R.RULEBASE) + "]"
_RB_SQL = "(VALUES " + ", ".join(
    "('{}', '{}')".format(p, (n + ". " + d).replace("'", "''")) for p, n, d in R.RULEBASE) + ") rb(rp, rule_text)"
_IDENT_SQL = f"""
ident AS (
  SELECT conv_id, turn, text, {_IDS_SQL}[turn % 18 + 1] AS pattern,
         list_append({_IDS_SQL}, 'AP11')[(conv_id + turn) % 19 + 1] AS result
  FROM conversations WHERE role = 'user')"""


_PIVOT_NAMES = {p: p.replace(".", "_") for p, _, _ in R.RULEBASE}


@register("q_result_pivot", f"""
WITH t AS (SELECT conv_id, {_IDS_SQL}[turn % 18 + 1] AS pattern, role, turn FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pattern ORDER BY turn, role) - 1 AS occurrence FROM t)
SELECT conv_id, CAST(occurrence AS INTEGER) AS occurrence, """ + ", ".join(
    f"max(CASE WHEN pattern = '{p}' THEN role END) AS {n}" for p, n in _PIVOT_NAMES.items()) + """
FROM n GROUP BY conv_id, occurrence""")
def q_result_pivot(spark, sf_dir):
    """Long (conversation, pattern of the turn, role) -> one column per
    pattern; a conversation that meets a pattern again gets a further row."""
    ids = F.array(*[F.lit(p) for p in _PIVOT_NAMES])
    t = table(spark, sf_dir, "conversations").withColumn("pattern", F.element_at(ids, (F.col("turn") % 18 + 1).cast("int")))
    wide = R.pivot_results(t, "conv_id", "pattern", "role", list(_PIVOT_NAMES), order="turn")
    return wide.withColumnsRenamed(_PIVOT_NAMES)


@register("q_flags", "WITH " + _IDENT_SQL + f"""
SELECT conv_id, turn, pattern, result, rp IS NOT NULL AS mapping,
       (rp IS NOT NULL AND result = pattern) AS epap
FROM ident LEFT JOIN {_RB_SQL} ON rb.rp = ident.result""")
def q_flags(spark, sf_dir):
    """Mapping (returned id in the rulebase) and epap (id = expected)."""
    f = R.classification_flags(_identified(spark, sf_dir))
    return f.select("conv_id", "turn", "pattern", "result", "mapping", "epap")


@register("q_prompt_build", "WITH " + _IDENT_SQL + f"""
SELECT conv_id, turn, result,
       'Identified changed pattern is ' || result || ' - ' || rule_text || '. \n Changes applied to the model: '
       || text || '.' AS prompt
FROM ident JOIN {_RB_SQL} ON rb.rp = ident.result""")
def q_prompt_build(spark, sf_dir):
    """Derive prompts of the mapped wordings (rulebase join)."""
    f = R.classification_flags(_identified(spark, sf_dir)).where("mapping")
    return f.select("conv_id", "turn", "result", R.derive_prompt(f).alias("prompt"))


@register("q_input_lookup", "WITH " + _IDENT_SQL + """
SELECT conv_id, turn, pattern,
       CASE pattern WHEN 'AP7' THEN 'ipm-7' WHEN 'AP15' THEN 'ipm-15' WHEN 'AP16' THEN 'ipm-16'
                    WHEN 'AP17' THEN 'ipm-17' WHEN 'AP18' THEN 'ipm-17' ELSE 'ipm-1' END AS input_name,
       'Consider following process model: ' ||
       CASE pattern WHEN 'AP7' THEN 'ipm-7' WHEN 'AP15' THEN 'ipm-15' WHEN 'AP16' THEN 'ipm-16'
                    WHEN 'AP17' THEN 'ipm-17' WHEN 'AP18' THEN 'ipm-17' ELSE 'ipm-1' END ||
       '\n Apply these changes to the model: ' || text AS prompt
FROM ident""")
def q_input_lookup(spark, sf_dir):
    """Input model of each wording's pattern and the change prompt
    (the model is named here; a caller joins its text)."""
    d = R.input_lookup(_identified(spark, sf_dir))
    return d.select("conv_id", "turn", "pattern", "input_name",
                    R.change_prompt(F.col("input_name"), F.col("text")).alias("prompt"))


@register("q_survey_prompts", "WITH " + _IDENT_SQL + """,
m AS (SELECT 'ipm-' || CAST(doc_id AS VARCHAR) AS name, text AS model FROM documents),
i AS (SELECT conv_id, pattern, text, CASE pattern WHEN 'AP7' THEN 'ipm-7' WHEN 'AP15' THEN 'ipm-15' WHEN 'AP16' THEN 'ipm-16'
                    WHEN 'AP17' THEN 'ipm-17' WHEN 'AP18' THEN 'ipm-17' ELSE 'ipm-1' END AS input_name FROM ident)
SELECT conv_id AS ordinal, pattern, input_name,
       'Consider following process model: ' || model || '\n Apply these changes to the model: ' || text AS prompt
FROM i LEFT JOIN m ON m.name = input_name WHERE text IS NOT NULL AND trim(text) <> ''""")
def q_survey_prompts(spark, sf_dir):
    """A wide sheet with row ordinals (a conversation's user
    turns by pattern) -> wordings -> change prompts that hold the text of the
    pattern's input model (documents stand for the input models)."""
    sheet = R.pivot_results(_identified(spark, sf_dir), "conv_id", "pattern", "text").withColumnRenamed("conv_id", "ordinal")
    long = R.unpivot_wordings(sheet, ["ordinal"], sheet.columns[2:])
    models = table(spark, sf_dir, "documents").select(F.concat(F.lit("ipm-"), F.col("doc_id").cast("string")).alias("name"), "text")
    out = R.input_texts(R.input_lookup(long), models)
    return out.select("ordinal", "pattern", "input_name", R.change_prompt(F.col("model_text"), F.col("text")).alias("prompt"))


_DOC_ROWS = """
dr AS (
  SELECT d.doc_id, d.source AS provider, d.lang AS pattern, l.quality = 1 AS mapping, l.toxic = 0 AS epap,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN 'NA' || chr(10)
              WHEN l.toxic = 1 THEN chr(9) || 'False' || chr(10) ELSE d.text END AS meaning
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _doc_status(spark, sf_dir):
    """The rows of ``_doc_rows`` with the gate in the place of the meaning: texts
    are gated where they are read, only the result is joined."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", B.meaning_ok(F.col("text")).alias("_ok"))
    status = (F.when(F.col("quality").isNull(), F.lit(None).cast("boolean"))
              .when(F.col("quality") == 0, B.meaning_ok(F.lit("NA\n"))).when(F.col("toxic") == 1, B.meaning_ok(F.lit("\tFalse\n")))
              .otherwise(F.col("_ok")))
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("provider"), F.col("lang").alias("pattern"), (F.col("quality") == 1).alias("mapping"),
        (F.col("toxic") == 0).alias("epap"), status.alias("meaning_status"))


def _doc_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    meaning = (F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
               .when(F.col("quality") == 0, "NA\n").when(F.col("toxic") == 1, "\tFalse\n")
               .otherwise(F.col("text")))
    return j.select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("pattern"),
                    (F.col("quality") == 1).alias("mapping"), (F.col("toxic") == 0).alias("epap"),
                    meaning.alias("meaning"))


@register("q_meaning_gate", "WITH " + _DOC_ROWS + """
SELECT doc_id, CASE WHEN meaning IS NULL THEN NULL
                    ELSE regexp_replace(meaning, '^\\s+|\\s+$', '', 'g') <> 'NA' AND lower(regexp_replace(meaning, '^\\s+|\\s+$', '', 'g')) <> 'false' END AS meaning_status
FROM dr""")
def q_meaning_gate(spark, sf_dir):
    """Usable meaning = not NULL, trimmed not NA, not false."""
    d = _doc_rows(spark, sf_dir)
    return d.select("doc_id", B.meaning_ok(F.col("meaning")).alias("meaning_status"))


_DOC_SIM = """
ds AS (SELECT doc_id, max(dice) AS sim, bool_or(exact) AS exact FROM ov GROUP BY doc_id),
comp AS (
  SELECT dr.*, CASE WHEN meaning IS NULL THEN NULL
                    ELSE regexp_replace(meaning, '^\\s+|\\s+$', '', 'g') <> 'NA' AND lower(regexp_replace(meaning, '^\\s+|\\s+$', '', 'g')) <> 'false' END AS meaning_status,
         CASE WHEN meaning IS NULL THEN NULL ELSE coalesce(ds.sim, 0.0) END AS similarity,
         CASE WHEN meaning IS NULL THEN NULL ELSE coalesce(ds.exact, FALSE) END AS is_exact
  FROM dr LEFT JOIN ds ON ds.doc_id = dr.doc_id)"""


def _doc_comp(spark, sf_dir):
    """Compare rows: gate plus the best overlap score of the document."""
    d = _doc_status(spark, sf_dir)
    # whether a score is 1 is decided on its integers, never on a rounded number
    best = doc_overlap(spark, sf_dir).groupBy("doc_id").agg(
        F.max("dice").alias("_sim"), F.bool_or(2 * F.col("i") == F.col("n1") + F.col("n2")).alias("_exact"))
    d = d.join(best, "doc_id", "left")
    meant = F.col("meaning_status").isNotNull()  # the gate is NULL for no meaning, and for nothing else
    return d.select("doc_id", "provider", "pattern", "mapping", "epap", "meaning_status",
                    F.when(meant, F.coalesce("_sim", F.lit(0.0))).alias("similarity"),
                    F.when(meant, F.coalesce("_exact", F.lit(False))).alias("is_exact"))


def _ov_sql():
    from flowmatch.plans.q_match import _DOC_SQL, _doc_metrics_sql
    return _DOC_SQL + f",\nov AS (SELECT doc_id, item_id, 2 * i = n1 + n2 AS exact, {_doc_metrics_sql()} FROM st),\n"


@register("q_carry_forward", _ov_sql() + _DOC_ROWS + "," + _DOC_SIM + """
SELECT doc_id, provider, pattern,
       last_value(meaning_status IGNORE NULLS) OVER w AS meaning_status,
       last_value(similarity IGNORE NULLS) OVER w AS similarity
FROM comp
WINDOW w AS (PARTITION BY provider, pattern ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_carry_forward(spark, sf_dir):
    """Rows without a meaning repeat the previous row's status and score
    (opt-in reproduction of the reference's stale values)."""
    c = cut_lineage(_doc_comp(spark, sf_dir))  # read by the rows and by the bucket tails
    c = B.carry_forward(c, ["provider", "pattern"], "doc_id", ["meaning_status", "similarity"],
                        bucket=F.floor(F.col("doc_id") / 1024))
    return c.select("doc_id", "provider", "pattern", "meaning_status", "similarity")


def _outcome_col():
    return A.outcome_code(F.col("mapping"), F.col("meaning_status"), F.col("epap"),
                          F.col("is_exact"))


_OUTCOME_SQL = """
CASE WHEN mapping = FALSE THEN 'False'
     WHEN meaning_status = FALSE THEN
       (CASE WHEN mapping IS NULL THEN 'None' WHEN mapping THEN 'True' ELSE 'False' END) || ',False'
     ELSE concat_ws(',',
       CASE WHEN mapping IS NULL THEN 'None' WHEN mapping THEN 'True' ELSE 'False' END,
       CASE WHEN meaning_status IS NULL THEN 'None' WHEN meaning_status THEN 'True' ELSE 'False' END,
       CASE WHEN epap IS NULL THEN 'None' WHEN epap THEN 'True' ELSE 'False' END,
       CASE WHEN is_exact IS NULL THEN 'None' WHEN is_exact THEN 'True' ELSE 'False' END)
END"""


@register("q_outcome_counts", _ov_sql() + _DOC_ROWS + "," + _DOC_SIM + f"""
SELECT provider, pattern, {_OUTCOME_SQL} AS outcome, count(*) AS n FROM comp GROUP BY ALL""")
def q_outcome_counts(spark, sf_dir):
    """A1/A2/A4: outcome code counts per provider and pattern."""
    c = _doc_comp(spark, sf_dir).withColumn("outcome", _outcome_col())
    return A.outcome_counts(c, ["provider", "pattern"])


@register("q_baseline_counts", _ov_sql() + _DOC_ROWS + "," + _DOC_SIM + """
SELECT provider, pattern, CASE WHEN coalesce(is_exact, FALSE) THEN 'True' ELSE 'False' END AS outcome,
       count(*) AS n
FROM comp GROUP BY ALL""")
def q_baseline_counts(spark, sf_dir):
    """A3: per provider and pattern, how many scores equal 1."""
    c = _doc_comp(spark, sf_dir).withColumn("is_exact", F.coalesce("is_exact", F.lit(False)))
    return A.success_counts(c, ["provider", "pattern"])


@register("q_provider_average", _ov_sql() + _DOC_ROWS + "," + _DOC_SIM + f""",
oc AS (SELECT provider, pattern, {_OUTCOME_SQL} AS outcome, count(*) AS n FROM comp GROUP BY ALL)
SELECT pattern, outcome, round(sum(n) / (SELECT count(DISTINCT provider) FROM oc), 6) AS avg_n
FROM oc GROUP BY pattern, outcome""")
def q_provider_average(spark, sf_dir):
    """A5: outcome counts averaged over providers (absent = 0)."""
    c = _doc_comp(spark, sf_dir).withColumn("outcome", _outcome_col())
    return A.provider_average(A.outcome_counts(c, ["provider", "pattern"]), "provider", ["pattern"])


@register("q_approach_compare", _ov_sql() + _DOC_ROWS + "," + _DOC_SIM + """
SELECT provider, pattern, CAST(grouping_id(provider, pattern) AS INTEGER) AS total_level,
       CAST(sum(CASE WHEN NOT mapping AND coalesce(similarity, 0.0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS baseline_success,
       CAST(sum(CASE WHEN mapping AND coalesce(similarity, 0.0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS meaning_success,
       CAST(sum(CASE WHEN NOT mapping THEN 1 ELSE 0 END) AS BIGINT) AS baseline_n,
       CAST(sum(CASE WHEN mapping THEN 1 ELSE 0 END) AS BIGINT) AS meaning_n
FROM comp WHERE mapping IS NOT NULL GROUP BY ROLLUP (provider, pattern)""")
def q_approach_compare(spark, sf_dir):
    """Baseline vs meaning approach side by side (quality 0 = baseline,
    1 = meaning; success = any overlap), with rollup subtotals."""
    c = _doc_comp(spark, sf_dir).where(F.col("mapping").isNotNull())
    c = c.withColumn("approach", F.when(F.col("mapping"), "meaning").otherwise("baseline"))
    return A.approach_compare(c, ["provider", "pattern"], "approach",
                              F.coalesce(F.col("similarity"), F.lit(0.0)) > 0, ["baseline", "meaning"])


@register("q_dense_ordinals", """
WITH g AS (SELECT DISTINCT quality, toxic FROM labels),
m AS (SELECT max(doc_id) AS mx FROM documents),
grid AS (SELECT quality, toxic, unnest(range(0, (SELECT mx FROM m) + 1)) AS ordinal FROM g)
SELECT grid.quality, grid.toxic, CAST(grid.ordinal AS INTEGER) AS ordinal,
       CAST(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS similarity
FROM grid LEFT JOIN labels l ON l.quality = grid.quality AND l.toxic = grid.toxic AND l.doc_id = grid.ordinal""")
def q_dense_ordinals(spark, sf_dir):
    """Every document ordinal per label group; absent rows score 0."""
    lab = table(spark, sf_dir, "labels").select("quality", "toxic", F.col("doc_id").alias("ordinal"),
                                                F.lit(1.0).alias("similarity"))
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] + 1  # one scalar
    return B.dense_ordinals(lab, ["quality", "toxic"], n=int(n))


@register("q_skip_done", """
SELECT o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def q_skip_done(spark, sf_dir):
    """Orders still to do = orders without an output row (returned items
    stand for outputs already written)."""
    todo = table(spark, sf_dir, "orders").select("o_orderkey")
    done = (table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").alias("o_orderkey")))
    return R.skip_done(todo, done, ["o_orderkey"])


def stub_client():
    """Deterministic stand-in for a text model: replies with the prompt's
    length; prompts whose length is a multiple of 7 always fail."""
    def call(prompt, system):
        if len(prompt) % 7 == 0:
            raise RuntimeError("stub failure")
        return str(len(prompt))
    return call


@register("q_batch_generate", """
SELECT conv_id, turn,
       CASE WHEN length(text) % 7 = 0 THEN NULL ELSE CAST(length(text) AS VARCHAR) END AS reply,
       CASE WHEN length(text) % 7 = 0 THEN 'RuntimeError: stub failure' END AS error,
       CASE WHEN length(text) % 7 = 0 THEN 3 ELSE 1 END AS attempts
FROM conversations WHERE role = 'user'""")
def q_batch_generate(spark, sf_dir):
    """Each distinct user wording generated once by a client built per
    task, paced and retried there; failures kept as error rows."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    out = G.batch_generate(c, "text", stub_client, partitions=8, min_interval=0.0, retry_wait=0.0)
    return out.select("conv_id", "turn", "reply", "error", "attempts")


# --------------------------------------------------------------------------
# M7 / M8 on traces: every weekly trace against its pattern's expected trace
# --------------------------------------------------------------------------

def _expected_pairs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    tr = T.traces(ev)
    up = ev.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("pattern"))
    ex = up.groupBy("pattern").agg(F.min("user_id").alias("xu"))
    xw = (ex.join(tr.withColumnRenamed("user_id", "xu"), "xu")
          .groupBy("pattern", "xu").agg(F.min("week").alias("xweek")))
    xw = counted_broadcast(cut_lineage(xw))  # a row for each pattern, read by the pairs and by their truth
    pairs = (tr.join(up, "user_id").join(xw, "pattern")
             .select("pattern", "user_id", "week",
                     F.struct(F.col("xu").alias("user_id"), F.col("xweek").alias("week")).alias("m1"),
                     T.model_key().alias("m2")))
    mine = F.to_date(F.date_trunc("week", "ts")) == F.col("xweek")
    of_expected = ev.join(xw.select(F.col("xu").alias("user_id"), "xweek").distinct(), "user_id").where(mine)
    return ev, tr, up, pairs, of_expected.select(ev.columns)


def _truth(of_expected):
    """Label counts of the expected traces alone, from their events."""
    return cut_lineage(S.label_counts(T.trace_labels(of_expected)))


def _week_ordinal(ev):
    w = F.to_date(F.date_trunc("week", F.col("ts")))
    lo, hi = ev.agg(F.min(w), F.max(w)).first()  # two scalars
    return lo, int((hi - lo).days // 7 + 1)


_EXP_SQL = "WITH " + O.TRACE_CTES.split("pp AS (")[0] + """
up AS (SELECT user_id, first(event_type ORDER BY ts, event_id) AS pattern FROM events GROUP BY user_id),
ex AS (SELECT pattern, min(user_id) AS xu FROM up GROUP BY pattern),
xw AS (SELECT ex.pattern, ex.xu, min(tr.week) AS xweek FROM ex JOIN tr ON tr.user_id = ex.xu GROUP BY ex.pattern, ex.xu),
pp AS (SELECT up.pattern, tr.user_id, tr.week, xw.xu, xw.xweek
       FROM tr JOIN up ON up.user_id = tr.user_id JOIN xw ON xw.pattern = up.pattern),
sides AS (
  SELECT pp.pattern, pp.user_id, pp.week, a.category, a.label, a.c AS c1, 0 AS c2
  FROM pp JOIN cnt a ON a.user_id = pp.xu AND a.week = pp.xweek
  UNION ALL
  SELECT pp.pattern, pp.user_id, pp.week, b.category, b.label, 0 AS c1, b.c AS c2
  FROM pp JOIN cnt b ON b.user_id = pp.user_id AND b.week = pp.week),
perlabel AS (SELECT pattern, user_id, week, category, label, sum(c1) AS c1, sum(c2) AS c2
             FROM sides GROUP BY pattern, user_id, week, category, label),
st AS (""" + O.stats_select(["pattern", "user_id", "week"], "perlabel") + """),
sc AS (SELECT pattern, user_id, week, """ + O.score_select("dice") + """ FROM st),
mw AS (SELECT min(week) AS w0, max(week) AS w1 FROM tr),
gk AS (SELECT DISTINCT up.pattern, tr.user_id FROM tr JOIN up ON up.user_id = tr.user_id),
grid AS (SELECT pattern, user_id, unnest(range(0, (SELECT CAST(datediff('day', w0, w1) / 7 AS BIGINT) + 1 FROM mw))) AS ordinal FROM gk),
dense AS (
  SELECT grid.pattern, grid.user_id, CAST(grid.ordinal AS INTEGER) AS ordinal,
         coalesce(sc.overall, 0.0) AS similarity, coalesce(sc.is_exact, FALSE) AS is_exact
  FROM grid LEFT JOIN sc ON sc.pattern = grid.pattern AND sc.user_id = grid.user_id
       AND CAST(datediff('day', (SELECT w0 FROM mw), sc.week) / 7 AS BIGINT) = grid.ordinal)
"""


def _batch_scores(spark, sf_dir):
    ev, tr, up, pairs, of_expected = _expected_pairs(spark, sf_dir)
    counts = S.label_counts(T.trace_labels(ev))
    sc = S.score_pairs(pairs, counts, pairs_unique=True, truth=counted_broadcast(_truth(of_expected))) \
          .withColumnRenamed("overall", "similarity")
    lo, n = _week_ordinal(ev)
    sc = sc.withColumn("ordinal", (F.datediff("week", F.lit(lo)) / 7).cast("int"))
    # read twice: for the groups and for their scores
    sc = cut_lineage(sc.select("pattern", "user_id", "ordinal", "similarity", "is_exact"))
    return ev, B.dense_ordinals(sc, ["pattern", "user_id"], n=n)


@register("q_batch_scores", _EXP_SQL + "SELECT * FROM dense")
def q_batch_scores(spark, sf_dir):
    """Weekly traces scored against their pattern's expected trace
    (pattern = the user's first event type; expected = that pattern's lowest
    user's first week); every week ordinal present, missing weeks 0."""
    return _batch_scores(spark, sf_dir)[1]


@register("q_gated_scores", _EXP_SQL + """,
mg AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week,
              CASE WHEN bool_or(event_type = 'error') THEN 'NA'
                   WHEN NOT bool_or(event_type = 'purchase') THEN 'False' ELSE 'valid' END AS meaning
       FROM events GROUP BY user_id, CAST(date_trunc('week', ts) AS DATE))
SELECT sc.pattern, sc.user_id, sc.week, mg.meaning,
       trim(mg.meaning) <> 'NA' AND lower(trim(mg.meaning)) <> 'false' AS meaning_status,
       sc.overall AS similarity
FROM sc JOIN mg ON mg.user_id = sc.user_id AND mg.week = sc.week""")
def q_gated_scores(spark, sf_dir):
    """Compare rows get a meaning gate (NA when the week had an error,
    False without a purchase) next to the expected-model score."""
    ev, tr, up, pairs, of_expected = _expected_pairs(spark, sf_dir)
    counts = S.label_counts(T.trace_labels(ev))
    sc = S.score_pairs(pairs, counts, pairs_unique=True, truth=counted_broadcast(_truth(of_expected)))
    mg = (T.trace_events(ev).groupBy("user_id", "week")
          .agg(F.when(F.bool_or(F.col("event_type") == "error"), "NA")
               .when(~F.bool_or(F.col("event_type") == "purchase"), "False")
               .otherwise("valid").alias("meaning")))
    out = sc.join(mg, ["user_id", "week"])
    return out.select("pattern", "user_id", "week", "meaning",
                      B.meaning_ok(F.col("meaning")).alias("meaning_status"),
                      F.col("overall").alias("similarity"))


@register("q_incremental_scores", _EXP_SQL + "SELECT pattern, user_id, week, overall AS similarity FROM sc")
def q_incremental_scores(spark, sf_dir):
    """Trace texts arrive as files in two batches (earlier weeks, then
    later weeks); a file stream parses and scores each batch against the
    expected traces.  The union of the batch outputs equals the batch query."""
    import uuid

    from flowmatch.session import checkpoint_dir, cut_lineage
    from flowmatch.streaming import incremental as X

    ev, tr, up, pairs, of_expected = _expected_pairs(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    lines = T.trace_lines(ev).select(F.col("model_id")["user_id"].alias("user_id"),
                                     F.col("model_id")["week"].alias("week"), "line_no",
                                     F.col("line").alias("value"))
    lo, n = _week_ordinal(ev)
    cut = F.date_add(F.lit(lo), 14)
    assign = pairs.select("user_id", "week", "pattern", "m1")
    counts = _truth(of_expected)
    assign = cut_lineage(assign)
    schema = ("user_id bigint, line_no struct<r: int, ts: timestamp_ntz, event_id: bigint>, "
              "value string, week date")
    for part in (F.col("week") < cut, F.col("week") >= cut):
        X.write_models(lines.where(part), f"{root}/in", ["user_id", "week"], ["week"])
        q = X.start_lines(spark, f"{root}/in", schema, ["user_id", "week"], assign, counts,
                          f"{root}/out", f"{root}/ckpt")
        q.awaitTermination()
    return (spark.read.parquet(f"{root}/out")
            .select("pattern", "user_id", "week", F.col("overall").alias("similarity")))


@register("q_incremental_files", _EXP_SQL + "SELECT pattern, user_id, week, overall AS similarity FROM sc")
def q_incremental_files(spark, sf_dir):
    """Trace texts arrive as whole ``.txt`` files, one a model, in
    two deliveries of a few weeks each; the second holds the first week's files
    once more.  A stream of whole files scores each model once."""
    import uuid

    from flowmatch.session import checkpoint_dir
    from flowmatch.sources.models import write_texts
    from flowmatch.streaming import incremental as X

    ev, tr, up, pairs, of_expected = _expected_pairs(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    # a model's text is one value: it is bounded by its model
    texts = T.trace_lines(ev).groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = cut_lineage(texts.select("model_id.*", F.array_join(F.col("l")["line"], "\n").alias("text")))
    lo, n = _week_ordinal(ev)
    cut = F.date_add(F.lit(lo), 14)
    assign = pairs.select("user_id", "week", "pattern", "m1")
    counts = _truth(of_expected)
    assign = cut_lineage(assign)
    for k, part in enumerate((F.col("week") < cut, (F.col("week") >= cut) | (F.col("week") == F.lit(lo)))):
        path = F.concat(F.lit("user_id="), "user_id", F.lit("/week="), "week", F.lit("/model.txt"))
        # a user's folder is one task's
        write_texts(dealt(texts.where(part), "user_id").select(path.alias("path"), "text"), f"{root}/in/delivery-{k}")
        q = X.start_files(spark, f"{root}/in", r"user_id=([^/]+)/week=([^/]+)/[^/]*\.txt$", {"user_id": "long", "week": "date"},
                          assign, counts, f"{root}/out", f"{root}/ckpt")
        q.awaitTermination()
    return (spark.read.parquet(f"{root}/out")
            .select("pattern", "user_id", "week", F.col("overall").alias("similarity")))


def _trace_models(spark, sf_dir):
    """Whole trace texts as candidates (pattern, user_id, week, model_id, text)
    and each pattern's expected text under an id of its own."""
    ev, tr, up, pairs, _ = _expected_pairs(spark, sf_dir)
    texts = T.trace_lines(ev).groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = cut_lineage(texts.select("model_id.*", F.array_join(F.col("l")["line"], "\n").alias("text")))
    cands = texts.join(up, "user_id").select("pattern", "user_id", "week", F.concat_ws("/", F.col("user_id").cast("string"), F.col("week").cast("string")).alias("model_id"), "text")
    first = pairs.select("pattern", F.col("m1")["user_id"].alias("user_id"), F.col("m1")["week"].alias("week")).distinct()
    expected = first.join(texts, ["user_id", "week"]).select("pattern", F.concat(F.lit("expected/"), "pattern").alias("model_id"), "text")
    return ev, cands, expected


@register("q_expected_scores", _EXP_SQL + "SELECT pattern, user_id, week, overall AS similarity, is_exact FROM sc")
def q_expected_scores(spark, sf_dir):
    """M7/W11 by its operator: whole model texts, parsed and scored against
    the expected text of their pattern."""
    _, cands, expected = _trace_models(spark, sf_dir)
    return B.score_against_expected(cands, expected).select("pattern", "user_id", "week", "similarity", "is_exact")


@register("q_meaning_scores", _EXP_SQL + """,
mg AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week,
              CASE WHEN bool_or(event_type = 'error') THEN ' NA'
                   WHEN NOT bool_or(event_type = 'purchase') THEN 'False' ELSE 'valid' END AS meaning
       FROM events GROUP BY user_id, CAST(date_trunc('week', ts) AS DATE)),
j AS (SELECT grid.pattern, grid.user_id, CAST(grid.ordinal AS INTEGER) AS ordinal, mg.meaning, sc.overall
      FROM grid LEFT JOIN mg ON mg.user_id = grid.user_id AND CAST(datediff('day', (SELECT w0 FROM mw), mg.week) / 7 AS BIGINT) = grid.ordinal
      LEFT JOIN sc ON sc.pattern = grid.pattern AND sc.user_id = grid.user_id AND CAST(datediff('day', (SELECT w0 FROM mw), sc.week) / 7 AS BIGINT) = grid.ordinal)
SELECT pattern, user_id, ordinal, meaning,
       last_value(CASE WHEN meaning IS NOT NULL THEN trim(meaning) <> 'NA' AND lower(trim(meaning)) <> 'false' END IGNORE NULLS) OVER w AS meaning_status,
       last_value(CASE WHEN meaning IS NOT NULL THEN coalesce(overall, 0.0) END IGNORE NULLS) OVER w AS similarity
FROM j WINDOW w AS (PARTITION BY pattern, user_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_meaning_scores(spark, sf_dir):
    """M8/W7/W9 by its operator: a derive row for every user and week, its
    meaning NULL in a week without events, joined to the score of its model;
    such a week repeats the row before."""
    ev, cands, expected = _trace_models(spark, sf_dir)
    lo, n = _week_ordinal(ev)
    ordinal = (F.datediff("week", F.lit(lo)) / 7).cast("int").alias("ordinal")
    mg = (T.trace_events(ev).groupBy("user_id", "week")
          .agg(F.when(F.bool_or(F.col("event_type") == "error"), " NA")
               .when(~F.bool_or(F.col("event_type") == "purchase"), "False").otherwise("valid").alias("meaning")))
    users = cands.select("user_id", "pattern").distinct()
    grid = users.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    derived = grid.join(mg.select("user_id", ordinal, "meaning"), ["user_id", "ordinal"], "left")
    cands = cands.withColumn("ordinal", ordinal).drop("week")
    out = B.score_meanings(derived, cands, expected, keys=("user_id", "pattern"), carry=True)
    return out.select("pattern", "user_id", "ordinal", "meaning", "meaning_status", "similarity")
