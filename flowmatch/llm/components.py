"""Connected components of a table of links, by alternating star contraction.

Each round is two joins and two aggregations over the links that are left;
no neighbourhood is ever gathered into one row or task.  The number of rounds
is logarithmic in the longest chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code

LINKS = 1 << 18  # links that one task contracts at a time


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` (longs, any direction, repeats and loops allowed) to
    ``(node, root)``: the smallest node of each linked node's component.

    Rows with a null end are ignored; nodes without a link are not returned.
    An empty table of links gives an empty result.
    """
    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.distinct())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def contracted(links: DataFrame) -> DataFrame:
    """``components`` of a checkpointed table of links: up to ``LINKS`` in one
    task, of more each task first contracts its own share to stars."""
    def run(batches):
        parts = [[b.column(k).to_numpy() for k in (0, 1)] for b in batches]
        if parts:
            node, root = stars(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

    ship_code(links.sparkSession)
    edges = links.where("u <> v").select("u", "v")
    tasks = -(-edges.count() // LINKS)
    local = edges.coalesce(max(1, tasks)).mapInArrow(run, "node long, root long")
    return kept(local) if tasks < 2 else components(local.toDF("u", "v"))
