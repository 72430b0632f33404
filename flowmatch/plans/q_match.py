"""Matching queries: vector greedy matching (L8-L12), one encoding per label
(L10) and word-multiset overlap of documents with benchmark items (L1-L7).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmatch.operators import listsim as LS
from flowmatch.plans.registry import register
from flowmatch.session import counted_broadcast, cut_lineage, spread
from flowmatch.sources.tables import table

# Fixed values of the test set-up: vectors per model (two halves of 8), the
# cosine threshold, the n-gram length of the blocking key.
MODEL_SIZE = 16
VEC_THRESHOLD = 0.2
GRAM = 5

_VEC_SCORES = f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id // {MODEL_SIZE} AS grp FROM embeddings),
a AS (SELECT * FROM e WHERE vec_id % 2 = 0),
b AS (SELECT * FROM e WHERE vec_id % 2 = 1),
s AS (
  SELECT a.label, a.grp, a.vec_id AS i1, b.vec_id AS i2,
         list_reduce(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0)
         / (sqrt(list_reduce(list_transform(a.v, lambda x: x * x), lambda x, y: x + y, 0.0))
            * sqrt(list_reduce(list_transform(b.v, lambda x: x * x), lambda x, y: x + y, 0.0))) AS score
  FROM a JOIN b ON a.label = b.label AND a.grp = b.grp),
c AS (
  SELECT label, grp,
         list({{'score': score, 'i1': i1, 'i2': i2}} ORDER BY score DESC, i1, i2) AS cand
  FROM s WHERE score >= {VEC_THRESHOLD} GROUP BY label, grp),
m AS (
  SELECT label, grp,
         list_reduce(cand, lambda acc, x:
           CASE WHEN list_contains(list_transform(acc, lambda y: y.i1), x.i1)
                  OR list_contains(list_transform(acc, lambda y: y.i2), x.i2)
                THEN acc ELSE list_append(acc, x) END,
           CAST([] AS STRUCT(score DOUBLE, i1 BIGINT, i2 BIGINT)[])) AS matched
  FROM c)"""


def _vec_edges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label", F.floor(F.col("vec_id") / MODEL_SIZE).cast("long").alias("grp"))
    a = e.where(F.col("vec_id") % 2 == 0).select("label", "grp", F.col("vec_id").alias("i1"),
                                                  F.col("embedding").alias("v1"))
    b = e.where(F.col("vec_id") % 2 == 1).select("label", "grp", F.col("vec_id").alias("i2"),
                                                  F.col("embedding").alias("v2"))
    return e, (a.join(b, ["label", "grp"])
               .select("label", "grp", "i1", "i2", LS.cosine(F.col("v1"), F.col("v2")).alias("score")))


@register("q_vector_match", "WITH " + _VEC_SCORES + """
SELECT label, grp, x.i1 AS i1, x.i2 AS i2, round(x.score, 6) AS score
FROM (SELECT label, grp, unnest(matched) AS x FROM m)""")
def q_vector_match(spark, sf_dir):
    """Cosine matrix of each model pair (even vs odd vectors of a
    label group of 16) and its greedy one-to-one matching at 0.2, in one plan."""
    _, edges = _vec_edges(spark, sf_dir)
    return LS.greedy_match(edges, ["label", "grp"], VEC_THRESHOLD, bounded=True).select(
        "label", "grp", "i1", "i2", F.round("score", 6).alias("score"))


@register("q_vector_sfa", "WITH " + _VEC_SCORES + f""",
n AS (SELECT label, grp, sum(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) AS n1,
             sum(CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 0 END) AS n2
      FROM e GROUP BY label, grp
      HAVING sum(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) > 0
         AND sum(CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 0 END) > 0)
SELECT n.label, n.grp, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       CAST(coalesce(len(m.matched), 0) AS BIGINT) AS i,
       round(CAST(2 * coalesce(len(m.matched), 0) AS DOUBLE) / CAST(n1 + n2 AS DOUBLE), 6) AS score,
       round(CAST(2 * n1 * n2 AS DOUBLE) / CAST(n1 + n2 AS DOUBLE), 6) AS weight
FROM n LEFT JOIN m ON m.label = n.label AND m.grp = n.grp""")
def q_vector_sfa(spark, sf_dir):
    """Semantic, frequency aware dice of each model pair's vector lists."""
    e, edges = _vec_edges(spark, sf_dir)
    model = F.struct("label", "grp")
    items1 = e.where(F.col("vec_id") % 2 == 0).select(
        model.alias("model_id"), F.col("vec_id").alias("i"), F.col("vec_id").cast("string").alias("label"))
    items2 = e.where(F.col("vec_id") % 2 == 1).select(
        model.alias("model_id"), F.col("vec_id").alias("i"), F.col("vec_id").cast("string").alias("label"))
    pairs = (items1.select("model_id").distinct()
             .join(items2.select("model_id").distinct(), "model_id")
             .select(F.col("model_id").alias("m1"), F.col("model_id").alias("m2")))
    sim = edges.select(F.struct("label", "grp").alias("m1"), F.struct("label", "grp").alias("m2"),
                       "i1", "i2", "score")
    out = LS.similarity_sfa(pairs, items1, items2, sim, VEC_THRESHOLD, "dice")
    return out.select(F.col("m1")["label"].alias("label"), F.col("m1")["grp"].alias("grp"),
                      "n1", "n2", "i", "score", "weight")


def letter_counts():
    """Stand-in for an embedding model: how often a label has each letter."""
    def encode(labels):
        return [[float(label.lower().count(chr(97 + k))) for k in range(26)] for label in labels]
    return encode


@register("q_label_encode_once", """
SELECT p_partkey, p_type,
       array_to_string(list_transform(range(97, 123), lambda c: length(p_type) - length(replace(lower(p_type), chr(CAST(c AS INTEGER)), ''))), ',') AS vector
FROM part""")
def q_label_encode_once(spark, sf_dir):
    """Each distinct label encoded once into a vector store, in two runs
    of which the second adds only what the first did not have; the vectors
    joined back to the rows."""
    import uuid

    from flowmatch.operators.encode import encode_labels
    from flowmatch.session import checkpoint_dir

    store = f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    first = part.where(F.crc32("p_brand") % 2 == 0).select(F.col("p_type").alias("label"))
    encode_labels(first, letter_counts, store)
    vectors = encode_labels(part.select(F.col("p_type").alias("label")), letter_counts, store)
    text = F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",")
    return part.join(vectors.select(F.col("label").alias("p_type"), text.alias("vector")), "p_type").select("p_partkey", "p_type", "vector")


# Fixed values of the test set-up: thresholds of the two label joins.
COSINE_JOIN, EDIT_JOIN = 0.45, 0.7


@register("q_cosine_join", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS id1, b.vec_id AS id2, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id <= b.vec_id)
SELECT id1, id2, round(score, 6) AS score FROM s WHERE score >= {COSINE_JOIN}""")
def q_cosine_join(spark, sf_dir):
    """All pairs of vectors (each with itself, too) from a cosine on."""
    from flowmatch.operators.simjoin import cosine_join
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector"))
    pairs = cosine_join(e, e, COSINE_JOIN).select(F.col("l1").cast("long").alias("id1"), F.col("l2").cast("long").alias("id2"), F.round("score", 6).alias("score"))
    return pairs.where("id1 <= id2")


@register("q_edit_join", f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT p_type AS name FROM part),
a AS (SELECT * FROM n UNION SELECT * FROM t),
s AS (SELECT a.name AS l1, b.name AS l2, 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) AS score
      FROM a, a b WHERE a.name < b.name AND least(length(a.name), length(b.name)) >= {EDIT_JOIN} * greatest(length(a.name), length(b.name)) - 1e-9)
SELECT l1, l2, round(score, 6) AS score FROM s WHERE score >= {EDIT_JOIN}""")
def q_edit_join(spark, sf_dir):
    """Another ``similarity_func``: all pairs of part names and types from a
    similarity by edits on, through an index of q-grams."""
    from flowmatch.operators.simjoin import by_edits
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("label")).unionByName(p.select(F.col("p_type").alias("label"))).distinct()
    pairs = by_edits()(names.withColumnRenamed("label", "l1"), names.withColumnRenamed("label", "l2"), EDIT_JOIN)
    return pairs.where("l1 < l2").select("l1", "l2", F.round("score", 6).alias("score"))


def words(col: F.Column) -> F.Column:
    """Lower-case words: runs of letters or digits."""
    spaced = F.trim(F.regexp_replace(F.lower(col), "[^\\p{L}\\p{N}]+", " "))
    return F.when(spaced != "", F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def grams(df, key: str, n: int = GRAM):
    """Word n-grams of every text (one row each), as two 64-bit hashes of the
    words; a text with fewer words, but not none, gives all of them as one."""
    w = F.col("w")
    last = F.greatest(F.size(w) - n, F.lit(0))

    def hashes(i):
        run = [F.get(w, i + k) for k in range(n)]
        return F.struct(F.xxhash64(*run).alias("g1"), F.xxhash64(F.lit(n), *run[::-1]).alias("g2"))
    return df.select(key, F.inline(F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), hashes))))


_DOC_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
                             lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
                              lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, array_to_string(w[i:i + {GRAM - 1}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {GRAM - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
bg AS (SELECT item_id, array_to_string(w[i:i + {GRAM - 1}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {GRAM - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
cand AS (SELECT DISTINCT dg.doc_id, bg.item_id FROM dg JOIN bg ON dg.g = bg.g),
dw AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY doc_id, word),
bw AS (SELECT item_id, word, count(*) AS c FROM (SELECT item_id, unnest(w) AS word FROM b) GROUP BY item_id, word),
n1 AS (SELECT item_id, sum(c) AS n1 FROM bw GROUP BY item_id),
n2 AS (SELECT doc_id, sum(c) AS n2 FROM dw GROUP BY doc_id),
x AS (SELECT cand.doc_id, cand.item_id, sum(least(dw.c, bw.c)) AS i
      FROM cand JOIN dw ON dw.doc_id = cand.doc_id JOIN bw ON bw.item_id = cand.item_id AND bw.word = dw.word
      GROUP BY cand.doc_id, cand.item_id),
st AS (SELECT cand.doc_id, cand.item_id, CAST(n1.n1 AS BIGINT) AS n1, CAST(n2.n2 AS BIGINT) AS n2,
              CAST(coalesce(x.i, 0) AS BIGINT) AS i
       FROM cand JOIN n1 ON n1.item_id = cand.item_id JOIN n2 ON n2.doc_id = cand.doc_id
       LEFT JOIN x ON x.doc_id = cand.doc_id AND x.item_id = cand.item_id)"""


def _doc_metrics_sql():
    from flowmatch.functions import metrics as M
    cols = [f"round({M.sql_metric(m, 'n1', 'n2', 'i')}, 6) AS {m}" for m in M.METHODS]
    cols.append(f"round({M.sql_weight('n1', 'n2')}, 6) AS weight")
    return ", ".join(cols)


def doc_overlap(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = raw.select("doc_id", words(F.col("text")).alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    # few grams of items and few candidates beside the documents: no text or gram of a document is shuffled for them
    ig = counted_broadcast(cut_lineage(grams(items, "item_id").distinct()))
    cand = cut_lineage(grams(docs, "doc_id").join(ig, ["g1", "g2"]).select("doc_id", "item_id").distinct())
    # words of candidate documents only: the semi join runs on the raw text
    dwc = (raw.join(counted_broadcast(cand.select("doc_id").distinct(), 1 << 20), "doc_id", "left_semi")
           .select(F.col("doc_id").alias("model_id"), F.explode(words(F.col("text"))).alias("label"))
           .groupBy("model_id", "label").agg(F.count(F.lit(1)).alias("cnt")))
    iwc = (items.select(F.col("item_id").alias("model_id"), F.explode("w").alias("label"))
           .groupBy("model_id", "label").agg(F.count(F.lit(1)).alias("cnt")))
    pairs = cand.select("doc_id", "item_id", F.col("item_id").alias("m1"), F.col("doc_id").alias("m2"))
    st = LS.list_stats(pairs, iwc, dwc)
    return st.select("doc_id", "item_id", "n1", "n2", "i", *LS.metric_columns())


@register("q_doc_overlap", _DOC_SQL + f"\nSELECT doc_id, item_id, n1, n2, i, {_doc_metrics_sql()} FROM st")
def q_doc_overlap(spark, sf_dir):
    """L1-L7 on word multisets: each document against the benchmark items it
    shares a word 5-gram with, or all its words if they are fewer (the item is
    the truth).  Pairs that share none are not compared and have no row."""
    return doc_overlap(spark, sf_dir)


# --------------------------------------------------------------------------
# Threshold matching inside model scoring
# --------------------------------------------------------------------------

# Fixed values of the test set-up: vectors of a model, expected models, labels that many models share.
SEMANTIC_MODEL, N_EXPECTED, SHARED = 8, 4, 40

_SEMANTIC_SQL = f"""
WITH v AS (SELECT 'v' || CAST(vec_id AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
raw AS (SELECT vec_id // {SEMANTIC_MODEL} AS m, vec_id, label FROM embeddings),
it AS (SELECT m, 'v' || CAST(vec_id AS VARCHAR) AS label, vec_id FROM raw
       UNION ALL SELECT m, 'v' || CAST(vec_id * 3 % {SHARED} AS VARCHAR), vec_id FROM raw WHERE vec_id % 4 = 0),
ty AS (SELECT m, 'type ' || CAST(label AS VARCHAR) AS kind FROM raw),
occ AS (SELECT m, label, row_number() OVER (PARTITION BY m, label ORDER BY vec_id) AS k FROM it),
pp AS (SELECT m % {N_EXPECTED} AS m1, m AS m2 FROM (SELECT DISTINCT m FROM it) WHERE m >= {N_EXPECTED}),
ex AS (SELECT pp.m1, pp.m2, a.label, a.k FROM pp JOIN occ a ON a.m = pp.m1 JOIN occ b ON b.m = pp.m2 AND b.label = a.label AND b.k = a.k),
r1 AS (SELECT pp.m1, pp.m2, a.label, a.k FROM pp JOIN occ a ON a.m = pp.m1
       WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.m1 = pp.m1 AND ex.m2 = pp.m2 AND ex.label = a.label AND ex.k = a.k)),
r2 AS (SELECT pp.m1, pp.m2, b.label, b.k FROM pp JOIN occ b ON b.m = pp.m2
       WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.m1 = pp.m1 AND ex.m2 = pp.m2 AND ex.label = b.label AND ex.k = b.k)),
lp AS (SELECT DISTINCT r1.label AS l1, r2.label AS l2 FROM r1 JOIN r2 ON r1.m1 = r2.m1 AND r1.m2 = r2.m2),
sim AS (SELECT l1, l2,
               list_reduce(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0)
               / (sqrt(list_reduce(list_transform(a.x, lambda x: x * x), lambda x, y: x + y, 0.0))
                  * sqrt(list_reduce(list_transform(b.x, lambda x: x * x), lambda x, y: x + y, 0.0))) AS score
        FROM lp JOIN v a ON a.label = l1 JOIN v b ON b.label = l2),
c AS (SELECT r1.m1, r1.m2, list({{'i1': r1.label || '#' || CAST(r1.k AS VARCHAR), 'i2': r2.label || '#' || CAST(r2.k AS VARCHAR)}}
                                ORDER BY score DESC, r1.label, r2.label, r1.k, r2.k) AS cand
      FROM r1 JOIN r2 ON r1.m1 = r2.m1 AND r1.m2 = r2.m2 JOIN sim ON sim.l1 = r1.label AND sim.l2 = r2.label
      WHERE score >= {VEC_THRESHOLD} GROUP BY r1.m1, r1.m2),
fz AS (SELECT m1, m2, len(list_reduce(cand, lambda acc, x:
           CASE WHEN list_contains(list_transform(acc, lambda y: y.i1), x.i1) OR list_contains(list_transform(acc, lambda y: y.i2), x.i2)
                THEN acc ELSE list_append(acc, x) END, CAST([] AS STRUCT(i1 VARCHAR, i2 VARCHAR)[]))) AS f FROM c),
n AS (SELECT m, count(*) AS n FROM it GROUP BY m),
nt AS (SELECT m, count(*) AS n FROM ty GROUP BY m),
te AS (SELECT pp.m1, pp.m2, sum(least(a.c, b.c)) AS i
       FROM pp JOIN (SELECT m, kind, count(*) AS c FROM ty GROUP BY m, kind) a ON a.m = pp.m1
       JOIN (SELECT m, kind, count(*) AS c FROM ty GROUP BY m, kind) b ON b.m = pp.m2 AND b.kind = a.kind GROUP BY pp.m1, pp.m2),
s AS (SELECT pp.m1, pp.m2, 2.0 * (e + f) / (n1 + n2) AS names, 2.0 * t / (t1 + t2) AS types, 2.0 * e / (n1 + n2) AS exact_names,
             2.0 * n1 * n2 / (n1 + n2) AS wn, 2.0 * t1 * t2 / (t1 + t2) AS wt
      FROM (SELECT pp.m1, pp.m2, n1.n AS n1, n2.n AS n2, t1.n AS t1, t2.n AS t2,
                   (SELECT count(*) FROM ex WHERE ex.m1 = pp.m1 AND ex.m2 = pp.m2) AS e, coalesce(fz.f, 0) AS f, coalesce(te.i, 0) AS t
            FROM pp JOIN n n1 ON n1.m = pp.m1 JOIN n n2 ON n2.m = pp.m2 JOIN nt t1 ON t1.m = pp.m1 JOIN nt t2 ON t2.m = pp.m2
            LEFT JOIN fz ON fz.m1 = pp.m1 AND fz.m2 = pp.m2 LEFT JOIN te ON te.m1 = pp.m1 AND te.m2 = pp.m2) pp)
SELECT m1 AS expected, m2 AS model, round(names, 6) AS task_names, round(types, 6) AS task_types,
       round((names * wn + types * wt) / (wn + wt), 6) AS overall, round(exact_names, 6) AS exact_task_names FROM s"""


@register("q_semantic_scores", _SEMANTIC_SQL)
def q_semantic_scores(spark, sf_dir):
    """M5 with threshold matching, over all vectors: every vector is a label of
    its model of eight, every fourth adds a label that many models share; each
    model is scored against one of four expected models.  Task names match
    when equal, else one-to-one by cosine of their label vectors, task types
    when equal.  ``exact_task_names`` is the score without the vectors."""
    from flowmatch.operators import score as S
    e = table(spark, sf_dir, "embeddings")
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    vectors = e.select(name(F.col("vec_id")).alias("label"), F.col("embedding").alias("vector"))
    model = F.floor(F.col("vec_id") / SEMANTIC_MODEL).cast("long").alias("model_id")
    shared = F.when(F.col("vec_id") % 4 == 0, name(F.col("vec_id") * 3 % SHARED))
    items = e.select(model, F.inline(F.array(
        F.struct(F.lit("task_names").alias("category"), name(F.col("vec_id")).alias("label")),
        F.struct(F.lit("task_names").alias("category"), shared.alias("label")),
        F.struct(F.lit("task_types").alias("category"), F.concat(F.lit("type "), F.col("label").cast("string")).alias("label")))))
    counts = S.label_counts(items)
    m = counts.select("model_id").distinct().where(F.col("model_id") >= N_EXPECTED)
    pairs = m.select((F.col("model_id") % N_EXPECTED).alias("m1"), F.col("model_id").alias("m2"))
    exact = S.score_pairs(pairs, counts, pairs_unique=True).select("m1", "m2", F.col("task_names").alias("exact_task_names"))
    out = S.score_pairs(pairs, counts, pairs_unique=True, vectors=vectors, threshold=VEC_THRESHOLD)
    return out.join(exact, ["m1", "m2"]).select(F.col("m1").alias("expected"), F.col("m2").alias("model"), "task_names", "task_types",
                                                "overall", "exact_task_names")
