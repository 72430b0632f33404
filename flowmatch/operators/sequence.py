"""Ordered successor within a group, without one task per group.

A trace (one user's week of events) may hold a large share of all rows, so
``lead`` over ``partitionBy(trace)`` would sort that share in a single task.
Instead the order key is cut into time buckets:

1. ``lead`` inside (trace, bucket) -- many small window partitions;
2. the head (first row) of every bucket, found by the same window;
3. ``lead`` over the bucket heads of a trace -- at most one row per bucket
   (168 hour buckets in a week with the default unit), never one row per event;
4. the last row of a bucket takes the head of the next non-empty bucket.

Where a group can have very many buckets, ``coarser`` maps a bucket to one of
a coarser cut, and step 3 runs in the same way over these, so that no window
holds all bucket heads of a group.

The result is exact: ordering by (bucket, order keys) equals ordering by the
order keys because the bucket is a monotone function of the first key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.session import dealt


def _linked_heads(heads: DataFrame, group_cols: list[str], coarser: Callable[[Column], Column] | None) -> DataFrame:
    """Bucket heads with the next bucket's head, and whether one is a group's first."""
    b = "_bucket"
    if coarser is None:
        w = Window.partitionBy(*group_cols).orderBy(b)
        return heads.withColumns({"_next_head": F.lead("_head").over(w), "is_first_bucket": F.lag(F.lit(1)).over(w).isNull()})
    h = heads.withColumn("_up", coarser(F.col(b)))
    w = Window.partitionBy(*group_cols, "_up").orderBy(b)
    h = h.withColumns({"_nxt_in": F.lead("_head").over(w), "_first_in": F.lag(F.lit(1)).over(w).isNull()})
    upper = h.groupBy(*group_cols, F.col("_up").alias(b)).agg(F.min("_head").alias("_head"))
    upper = _linked_heads(upper, group_cols, None).select(
        *group_cols, F.col(b).alias("_up"), F.col("_next_head").alias("_nxt_up"), F.col("is_first_bucket").alias("_first_up"))
    h = h.join(upper, [*group_cols, "_up"])
    return h.select(*heads.columns, F.coalesce("_nxt_in", "_nxt_up").alias("_next_head"),
                    (F.col("_first_in") & F.col("_first_up")).alias("is_first_bucket"))


def with_successor(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   payload_cols: list[str], bucket: Column | None, prefix: str = "next_",
                   coarser: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``<prefix><payload>`` columns holding the next row's payload.

    Returns ``(rows, heads)``: rows with successor columns (NULL for the last
    row of a group) and, per (group, bucket), the bucket head with
    ``is_first_bucket`` so callers can find each group's first row without
    another window.  Without a bucket (None) a group is one bucket, in one
    window: for groups that end up in one row anyway.
    """
    b = "_bucket"
    keys = group_cols + [b]
    # dealt once: the window and the heads below read the same exchange
    fields = order_cols + [c for c in payload_cols if c not in order_cols]
    rec = F.struct(*[F.col(c) for c in fields])
    if bucket is None:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        d = df.repartition(*group_cols).withColumns({"_nxt": F.lead(rec).over(w), "_first": F.lag(F.lit(1)).over(w).isNull()})
        heads = d.where("_first").select(*group_cols, F.lit(True).alias("is_first_bucket"), *fields)
        return d.select(*df.columns, *[F.col("_nxt")[c].alias(prefix + c) for c in payload_cols]), heads
    d = dealt(df.withColumn(b, bucket), *keys)
    w_in = Window.partitionBy(*keys).orderBy(*order_cols)
    d = d.withColumns({"_nxt": F.lead(rec).over(w_in), "_first": F.lag(F.lit(1)).over(w_in).isNull()})
    heads = d.where("_first").select(*keys, rec.alias("_head"))
    heads = _linked_heads(heads, group_cols, coarser)
    d = d.join(heads.select(*keys, "_next_head"), keys, "left")
    nxt = F.coalesce(F.col("_nxt"), F.col("_next_head"))
    d = d.select(*df.columns, *[nxt[c].alias(prefix + c) for c in payload_cols])
    heads = heads.select(*group_cols, "is_first_bucket",
                         *[F.col("_head")[c].alias(c) for c in fields])
    return d, heads
