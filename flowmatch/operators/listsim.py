"""Single-list similarity and fuzzy one-to-one matching.

``list_stats`` scores two multisets of strings per pair by stacked counts.
``greedy_match`` is the one-to-one matching of scored item pairs: best score
first, ties by (i1, i2), each item used once, ``score >= threshold``.  Groups
that one model pair bounds are folded in one plan.  For groups of any size it is
computed as rounds of *locally dominant* edges -- an edge that comes first
in that order among all remaining edges touching either of its items is the
edge the sequential greedy takes -- so every round is two windows over
(group, item) and no group is ever gathered into one task.  The driver loop
only counts remaining edges; lineage is cut with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from flowmatch.functions import metrics as M
from flowmatch.session import checkpoint_dir, ship_by_value


def list_stats(pairs: DataFrame, c1: DataFrame, c2: DataFrame) -> DataFrame:
    """L7 + count join: ``pairs`` (m1, m2, ...), ``c1``/``c2`` (model_id, label,
    cnt) -> pairs with n1, n2, i (BIGINT).  m1 is the truth list.

    Both sides are stacked and summed per (pair, label), then folded per pair,
    so each count table is read once and no join on labels is needed."""
    keys = pairs.select("m1", "m2").distinct()
    s1 = keys.join(c1.select(F.col("model_id").alias("m1"), "label", F.col("cnt").alias("a")), "m1") \
             .withColumn("b", F.lit(0).cast("long"))
    s2 = keys.join(c2.select(F.col("model_id").alias("m2"), "label", F.col("cnt").alias("b")), "m2") \
             .withColumn("a", F.lit(0).cast("long"))
    per_label = (s1.unionByName(s2).groupBy("m1", "m2", "label")
                 .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    st = per_label.groupBy("m1", "m2").agg(
        F.sum("a").cast("long").alias("n1"), F.sum("b").cast("long").alias("n2"),
        F.sum(F.least("a", "b")).cast("long").alias("i"))
    return pairs.join(st, ["m1", "m2"], "left").fillna({"n1": 0, "n2": 0, "i": 0})


def metric_columns(digits: int | None = 6) -> list[Column]:
    """dice, jaccard, precision, recall, f1 and the harmonic weight from n1, n2, i."""
    n1, n2, i = F.col("n1"), F.col("n2"), F.col("i")
    out = [(m, M.metric(m, n1, n2, i)) for m in M.METHODS] + [("weight", M.harmonic_weight(n1, n2))]
    return [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in out]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, summed left to right in double."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return dot / (F.sqrt(na) * F.sqrt(nb))


def greedy_counts(edges: DataFrame, group_cols: list[str], threshold: float) -> DataFrame:
    """L11 on labels with multiplicities: ``edges`` (group..., i1, i2, score,
    a, b), ``a`` / ``b`` being how many items i1 / i2 stand for (the same on
    all edges of a label).  Returns the taken edges with ``m`` matches each.

    Equal to the sequential greedy over single items (best score first, ties
    by i1, i2, each item once, ``score >= threshold``): taking an edge uses
    min(a, b) items of both ends, which exhausts one of them.  Each round takes
    every edge that comes first among the remaining edges of both its ends,
    and writes one checkpoint; the loop ends when no edge is left."""
    checkpoint_dir(edges.sparkSession)
    order = [F.col("score").desc(), F.col("i1").asc(), F.col("i2").asc()]
    by1, by2 = Window.partitionBy(*group_cols, "i1"), Window.partitionBy(*group_cols, "i2")
    rem = edges.where(F.col("score") >= threshold).select(*group_cols, "i1", "i2", "score", "a", "b")
    rounds = []
    while True:
        first = (F.row_number().over(by1.orderBy(*order)) == 1) & (F.row_number().over(by2.orderBy(*order)) == 1)
        marked = rem.withColumn("m", F.when(first, F.least("a", "b"))).checkpoint(eager=True)
        if marked.isEmpty():
            break
        rounds.append(marked.where(F.col("m").isNotNull()))
        # an end has one taken edge a round at most, so max() finds what it used
        rem = (marked.withColumn("a", F.col("a") - F.coalesce(F.max("m").over(by1), F.lit(0)))
               .withColumn("b", F.col("b") - F.coalesce(F.max("m").over(by2), F.lit(0)))
               .where("a > 0 and b > 0").drop("m"))
    out = marked  # no rows
    for taken in rounds:
        out = out.unionByName(taken)
    return out


def greedy_fold(edges: DataFrame, group_cols: list[str], threshold: float) -> DataFrame:
    """As ``greedy_counts``, in one plan without a job before the action: each
    group's edges are sorted into one value and taken in that order.

    For groups that are bounded by the model pair they belong to, such as the
    distinct labels that two models' texts leave unmatched."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "i1", "i2", "score", "a", "b")))
    groups = edges.where(F.col("score") >= threshold).groupBy(*group_cols).agg(order.alias("edges"))
    ship_by_value(__name__)
    taken = groups.mapInArrow(_fold, StructType([*groups.schema.fields, StructField("m", ArrayType(LongType()))]))
    each = taken.select(*group_cols, F.explode(F.arrays_zip("edges", "m")).alias("e")).where("e.m > 0")
    return each.select(*group_cols, *[F.col(f"e.edges.{c}").alias(c) for c in ("i1", "i2", "score", "a", "b")], F.col("e.m").alias("m"))


def _fold(batches):
    """Matches of each group's edges, best first: an edge takes what both its ends have left."""
    import pyarrow as pa

    for batch in batches:
        taken = []
        for edges in batch.column("edges").to_pylist():
            left1, left2, m = {e["i1"]: e["a"] for e in edges}, {e["i2"]: e["b"] for e in edges}, []
            for e in edges:
                n = min(left1[e["i1"]], left2[e["i2"]])
                left1[e["i1"]] -= n
                left2[e["i2"]] -= n
                m.append(n)
            taken.append(m)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.list_(pa.int64()))], [*batch.schema.names, "m"])


def greedy_match(edges: DataFrame, group_cols: list[str], threshold: float, bounded: bool = False) -> DataFrame:
    """One-to-one greedy matching of (group..., i1, i2, score) edges;
    returns the matched edges.  ``bounded`` says that a group is one model
    pair's, so that it is folded in one plan (``greedy_fold``)."""
    one = F.lit(1).cast("long")
    match = greedy_fold if bounded else greedy_counts
    return (match(edges.withColumns({"a": one, "b": one}), group_cols, threshold)
            .select(*group_cols, "i1", "i2", "score"))


def label_similarity(label_pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``label_pairs`` (l1, l2) -> (l1, l2, score), each distinct pair
    computed once from ``vectors`` (label, vector), one encoding per distinct
    label.  A label without a vector is similar to none but itself."""
    v = vectors.dropDuplicates(["label"])
    return (label_pairs.select("l1", "l2").distinct()
            .join(v.select(F.col("label").alias("l1"), F.col("vector").alias("_v1")), "l1")
            .join(v.select(F.col("label").alias("l2"), F.col("vector").alias("_v2")), "l2")
            .select("l1", "l2", cosine(F.col("_v1"), F.col("_v2")).alias("score")))


def similar_counts(left: DataFrame, keys: list[str], similarity, threshold: float) -> DataFrame:
    """Items matched by similarity alone: ``left`` (keys..., label, a, b) holds
    what the exact matching of two lists left on either side (one of a, b is
    0); returns (keys..., i) with the size of the greedy matching.

    ``similarity`` is a threshold join of labels (``simjoin``), or a table
    (label, vector): then the cosine of the label pairs that meet is taken."""
    s1 = left.where("a > 0").select(*keys, F.col("label").alias("l1"), "a")
    s2 = left.where("b > 0").select(*keys, F.col("label").alias("l2"), "b")
    if callable(similarity):
        sims = similarity(s1.select("l1").distinct(), s2.select("l2").distinct(), threshold)
        edges = s1.join(sims, "l1").join(s2, [*keys, "l2"])
    else:
        cand = s1.join(s2, keys)
        sims = label_similarity(cand, similarity).where(F.col("score") >= threshold)
        edges = cand.join(sims, ["l1", "l2"])
    edges = edges.withColumnsRenamed({"l1": "i1", "l2": "i2"})
    return greedy_fold(edges, keys, threshold).groupBy(*keys).agg(F.sum("m").cast("long").alias("i"))


def similarity_sfa(pairs: DataFrame, items1: DataFrame, items2: DataFrame, sim: DataFrame | None,
                   threshold: float, method: str = "dice", digits: int | None = 6) -> DataFrame:
    """Semantic and frequency aware list similarity per pair.

    ``items1``/``items2``: (model_id, i, label) list items; ``sim``: scored
    item pairs (m1, m2, i1, i2, score) or None for exact labels only.
    Exact labels are matched first by count (an identical string scores the
    maximum); the rest go through ``greedy_match``.  I = number of matches."""
    M.metric(method, F.lit(0), F.lit(0), F.lit(0))
    keys = pairs.select("m1", "m2").distinct()
    a = items1.select(F.col("model_id").alias("m1"), F.col("i").alias("i1"), F.col("label").alias("l1"))
    b = items2.select(F.col("model_id").alias("m2"), F.col("i").alias("i2"), F.col("label").alias("l2"))
    # exact matches: k-th occurrence of a label on one side with the k-th on the other
    wa = Window.partitionBy("m1", "m2", "l1").orderBy("i1")
    wb = Window.partitionBy("m1", "m2", "l2").orderBy("i2")
    ka = keys.join(a, "m1").withColumn("_k", F.row_number().over(wa))
    kb = keys.join(b, "m2").withColumn("_k", F.row_number().over(wb))
    exact = ka.join(kb, (ka.m1 == kb.m1) & (ka.m2 == kb.m2) & (ka.l1 == kb.l2) & (ka._k == kb._k)) \
              .select(ka.m1, ka.m2, "i1", "i2")
    n = (keys.join(a.groupBy("m1").agg(F.count(F.lit(1)).alias("n1")), "m1", "left")
         .join(b.groupBy("m2").agg(F.count(F.lit(1)).alias("n2")), "m2", "left"))
    ex = exact.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("i_exact"))
    st = n.join(ex, ["m1", "m2"], "left")
    if sim is not None:
        # a model may take part in many pairs: what is left is left of a pair
        cand = (sim.join(keys, ["m1", "m2"], "left_semi")
                .join(exact.select("m1", "m2", "i1"), ["m1", "m2", "i1"], "left_anti")
                .join(exact.select("m1", "m2", "i2"), ["m1", "m2", "i2"], "left_anti"))
        fm = greedy_match(cand, ["m1", "m2"], threshold, bounded=True)
        st = st.join(fm.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("i_fuzzy")), ["m1", "m2"], "left")
    else:
        st = st.withColumn("i_fuzzy", F.lit(0))
    st = st.select("m1", "m2", F.coalesce("n1", F.lit(0)).cast("long").alias("n1"),
                   F.coalesce("n2", F.lit(0)).cast("long").alias("n2"),
                   (F.coalesce("i_exact", F.lit(0)) + F.coalesce("i_fuzzy", F.lit(0))).cast("long").alias("i"))
    out = pairs.join(st, ["m1", "m2"])
    sc = M.metric(method, F.col("n1"), F.col("n2"), F.col("i"))
    w = M.harmonic_weight(F.col("n1"), F.col("n2"))
    if digits is not None:
        sc, w = F.round(sc, digits), F.round(w, digits)
    return out.withColumn("score", sc).withColumn("weight", w)
