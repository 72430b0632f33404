"""Batch model-to-model scoring (M7, M8) and its reshaping helpers.

Candidates are scored against the one expected model of their pattern.  The
expected side is tiny and shared by many candidates, so it is broadcast
behind a row-count check; each model's text is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.functions.text import strip
from flowmatch.operators import labels as L
from flowmatch.operators import parse as P
from flowmatch.operators import score as S
from flowmatch.session import counted_broadcast, cut_lineage

# The comparison settings of both batch comparisons.
DEFAULT_METHOD = "dice"
DEFAULT_THRESHOLD = 0.95


def model_counts(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse (model_id, text) and return (label counts, scorable flags)."""
    p = P.parse_models(models.select("model_id", "text"))
    labels = L.model_labels(p["elements"], L.parsed_flows(p["flows"]))
    return S.label_counts(labels), p["flags"]


def score_against_expected(cands: DataFrame, expected: DataFrame, key: str = "pattern",
                           method: str = DEFAULT_METHOD, digits: int | None = 6,
                           vectors: DataFrame | None = None,
                           threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Each candidate (key, model_id, text, ...) against the expected
    model (key, model_id, text) of its key.  Adds ``similarity`` (= overall;
    0 for unscorable pairs) and ``is_exact``.  With ``vectors`` (label, vector)
    labels also match by cosine similarity from ``threshold`` on.  The expected
    models are read and parsed on their own first; many candidates share them."""
    expected = cut_lineage(expected.select(key, "model_id", "text"))
    exp = counted_broadcast(expected.select(key, F.col("model_id").alias("m1")))
    truth = counted_broadcast(cut_lineage(model_counts(expected)[0]))
    pairs = (cands.drop("text").withColumnRenamed("model_id", "m2").join(exp, key))
    models = (cands.select("model_id", "text")
              .unionByName(expected.select("model_id", "text")))
    counts, flags = model_counts(models)
    out = S.score_pairs(pairs, counts, method=method, pairs_unique=True, model_flags=flags,
                        digits=digits, vectors=vectors, threshold=threshold, truth=truth)
    return (out.withColumnRenamed("overall", "similarity")
            .select(*[c for c in pairs.columns if c != "m1"], "similarity", "is_exact")
            .withColumnRenamed("m2", "model_id"))


def dense_ordinals(scores: DataFrame, keys: list[str], n: int,
                   ordinal: str = "ordinal", value: str = "similarity") -> DataFrame:
    """Every ordinal 0..n-1 per key group; a missing model scores 0.

    ``n`` is the caller's list length; scored rows with an ordinal outside it
    are kept too.  The missing rows are made in blocks of ordinals, so neither
    a row nor a task holds all ordinals of a group."""
    block = 1024
    groups = scores.select(*keys).distinct()
    blocks = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // block)))).alias("_b"))
    blocks = blocks.repartition(*keys, "_b")
    scaffold = blocks.select(*keys, F.explode(F.sequence(
        F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.lit(n)) - 1)).alias(ordinal)) \
        if n > 0 else blocks.select(*keys, F.col("_b").alias(ordinal)).where("false")
    scaffold = scaffold.unionByName(scores.where((F.col(ordinal) < 0) | (F.col(ordinal) >= n)).select(
        *keys, F.col(ordinal).cast(scaffold.schema[ordinal].dataType).alias(ordinal)).distinct())
    s = scores.select(*keys, ordinal, value, *[c for c in ("is_exact",) if c in scores.columns])
    out = scaffold.join(s, keys + [ordinal], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    if "is_exact" in scores.columns:
        out = out.withColumn("is_exact", F.coalesce("is_exact", F.lit(False)))
    return out


def meaning_ok(meaning: Column) -> Column:
    """A usable meaning is non-NULL and, without white space round it, neither ``NA`` nor ``false``
    (any case).  NULL in, NULL out."""
    m = strip(meaning)
    return F.when(meaning.isNull(), F.lit(None).cast("boolean")) \
            .otherwise((m != "NA") & (F.lower(m) != "false"))


def _before(tails: DataFrame, keys: list[str], cols: list[str], fan: int, levels: int) -> DataFrame:
    """(keys..., _b, _p_<col>): the last non-NULL of the buckets before _b.

    With ``levels`` the buckets themselves are put in buckets of ``fan``, so
    that a window never holds more than that many of a group's buckets."""
    run = Window.unboundedPreceding
    if levels == 0:
        w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(run, -1)
        return tails.select(*keys, "_b", *[F.last(c, ignorenulls=True).over(w).alias(f"_p_{c}") for c in cols])
    t = tails.withColumn("_u", F.floor(F.col("_b") / fan))
    w = Window.partitionBy(*keys, "_u").orderBy("_b").rowsBetween(run, -1)
    t = t.withColumns({f"_in_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
    upper = t.groupBy(*keys, "_u").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_b"))).alias(c) for c in cols])
    upper = _before(upper.withColumnRenamed("_u", "_b"), keys, cols, fan, levels - 1).withColumnRenamed("_b", "_u")
    t = t.select(*keys, "_b", "_u", *[f"_in_{c}" for c in cols]).join(upper, keys + ["_u"], "left")
    return t.select(*keys, "_b", *[F.coalesce(f"_in_{c}", f"_p_{c}").alias(f"_p_{c}") for c in cols])


def carry_forward(df: DataFrame, keys: list[str], order: str, cols: list[str],
                  bucket: Column | None = None, fan: int = 1024, levels: int = 1) -> DataFrame:
    """Fill NULLs of ``cols`` with the last non-NULL value earlier in the
    group (the reference's stale-variable behaviour, opt-in).

    With ``bucket`` (a number that grows with ``order``) the running window
    runs per (group, bucket) and only one row per bucket crosses buckets;
    these are bucketed again by ``fan``, ``levels`` times, so a huge group is
    never sorted in one task."""
    run = Window.unboundedPreceding
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(run, 0)
        return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})
    d = df.withColumn("_b", bucket)
    w_in = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(run, 0)
    d = d.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w_in) for c in cols})
    tails = d.groupBy(*keys, "_b").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])
    d = d.join(_before(tails, keys, cols, fan, levels), keys + ["_b"], "left")
    d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_p_{c}")) for c in cols})
    return d.select(*df.columns)


def score_meanings(derived: DataFrame, cands: DataFrame, expected: DataFrame,
                   keys: tuple[str, str] = ("provider", "pattern"), ordinal: str = "ordinal",
                   method: str = DEFAULT_METHOD, carry: bool = False, vectors: DataFrame | None = None,
                   threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """M8: derive rows (keys, ordinal, mapping, epap, user, meaning) get
    ``meaning_status`` and ``similarity`` of the candidate with the same keys
    and ordinal.  A NULL meaning gives NULL status and similarity unless
    ``carry`` repeats the previous row's values."""
    sc = score_against_expected(cands, expected, key=keys[1], method=method, vectors=vectors, threshold=threshold)
    sc = sc.select(*keys, ordinal, "similarity")
    d = derived.withColumn("meaning_status", meaning_ok(F.col("meaning")))
    d = d.join(sc, list(keys) + [ordinal], "left")
    d = d.withColumn("similarity", F.when(F.col("meaning").isNull(), F.lit(None).cast("double"))
                     .otherwise(F.coalesce("similarity", F.lit(0.0))))
    if carry:
        d = carry_forward(d, list(keys), ordinal, ["meaning_status", "similarity"])
    return d
