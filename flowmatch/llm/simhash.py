"""SimHash near-duplicates: fingerprints, and exact links within a Hamming
radius through vantage-point trees.

A vantage-point tree cuts points by their distance to a vantage point.  By the
triangle inequality two points at distance e have distances to any vantage
point that differ by at most e (and, for Hamming distance, by e, e - 2, ...),
so only the children whose rings overlap can hold a partner.  Over all 64 bits
such rings prune little, as distances crowd round 32.  So the bits are cut in
``trees`` blocks with a tree each: fingerprints that differ in at most
``max_bits`` bits differ in at most ``max_bits // trees`` bits of some block,
and in that block's tree rings are narrow against their spread.

A fingerprint has one home leaf in each tree; it also visits the leaves that
its radius overlaps, always the one side of each pair of leaves, so that every
pair meets.  Leaves are the shards that Spark deals out; inside one, two more
levels of rings and an exact comparison of all 64 bits follow.  A leaf above
``leaf_rows`` is cut into chunks and its pairs of chunks are dealt out, so no
task gathers more than two chunks; each returns a spanning forest of what it
links, never all pairs of a group of copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, signed, text_or_empty
from flowmatch.llm.components import components

SEED = 42
LEAF_ROWS = 20_000   # most rows of a chunk of a leaf
LEAF_TARGET = 4_096  # home rows of an average leaf, from which the depth follows
RING_SHARE = 8       # rings that hold most points of a level


def fingerprint(text: str, words: int) -> int:
    """64-bit SimHash of the ``words``-word shingles of a text, repeats counted."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs(doc_id, text, ...)``; ``fp`` is
    the fingerprint's bit pattern as a long.

    A null text counts as empty and gets fingerprint zero, as does a text
    without words.  Repeated rows stay repeated; a null doc_id stays null.
    """
    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(t, words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(trees: int) -> list[int]:
    """Bit masks of ``trees`` blocks of near equal width that cover 64 bits."""
    cuts = [round(64 * i / trees) for i in range(trees + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _routed(points: DataFrame, depth: int, radius: int, masks: list[int]) -> DataFrame:
    """Every point's home row and visits: ``(fp, tree, path, home)``."""
    mask = F.array(*[F.lit(signed(m)) for m in masks])[F.col("tree")]
    width = F.array(*[F.lit(m.bit_count()) for m in masks])[F.col("tree")]
    rows = points.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("tree"))
    rows = rows.withColumns({"mask": mask, "width": width, "path": F.lit(0).cast("long"), "first": F.lit(False)})
    rows = rows.withColumn("apart", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    for level in range(depth):
        vantage = F.xxhash64(F.lit(level), "tree", "path")
        ring = F.bit_count(F.col("fp").bitwiseXOR(vantage).bitwiseAND(F.col("mask")))
        rows = rows.withColumn("off", F.explode(F.expr("sequence(-apart, apart, 2)")))
        rows = rows.withColumn("ring", ring + F.col("off")).where("ring between 0 and width and (first or off >= 0)")
        rows = rows.withColumns({"path": F.col("path") * 64 + F.col("ring") + 1, "first": F.expr("first or off > 0")})
    # the home leaf, and visits to the leaves on one side of it
    return rows.where("apart = 0 or first").select("fp", "tree", "path", (F.col("apart") == 0).alias("home"))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index reachable) after linking a[i] with b[i]."""
    while len(a):
        la, lb = label[a], label[b]
        new = la != lb
        if not new.any():
            break
        a, b, la, lb = a[new], b[new], la[new], lb[new]
        label[np.maximum(la, lb)] = np.minimum(la, lb)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def leaf_links(fp: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int, step: int = 1 << 20) -> np.ndarray:
    """For each row of a leaf the first row that it is linked to, directly or
    through other rows: exact over pairs that hold a home row."""
    label = np.arange(len(fp))
    homes = np.flatnonzero(home)
    if not len(homes):
        return label
    spots = [np.uint64(xxhash.xxh64_intdigest(b"vantage", i) & mask) for i in (1, 2)]
    rings = [np.bitwise_count((fp & np.uint64(mask)) ^ s).astype(np.int64) for s in spots]
    key = rings[0] * 128 + rings[1]
    homes = homes[np.argsort(key[homes], kind="stable")]
    home_key = key[homes]
    for apart in range(radius + 1):
        offsets = range(-apart, apart + 1, 2) if apart else (0,)
        for o in (x * 128 + y for x in offsets for y in offsets):
            low = np.searchsorted(home_key, key + o, "left")
            size = np.searchsorted(home_key, key + o, "right") - low
            ends = np.cumsum(size)
            at = 0
            while at < len(fp):
                # as many rows as have about `step` candidates together
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
                n = size[at:to]
                row = np.repeat(np.arange(at, to), n)
                base = np.repeat(low[at:to] - (ends[at:to] - n), n)
                other = homes[base + np.arange(ends[at] - n[0], ends[to - 1])] if len(row) else row
                near = (label[row] != label[other]) & (np.bitwise_count(fp[row] ^ fp[other]) <= max_bits)
                label = _merge(label, row[near], other[near])
                at = to
    return label


def near_links(points: DataFrame, max_bits: int = 4, trees: int = 3, leaf_rows: int = LEAF_ROWS,
               leaf_target: int = LEAF_TARGET) -> DataFrame:
    """Links ``(u, v)`` between the distinct values of ``points.fp`` that span
    every group of fingerprints joined by steps of ``max_bits`` bits or fewer.

    Exact: a fingerprint is linked with another one's group if and only if
    some chain of such steps joins them.  Nulls are ignored; fewer than two
    fingerprints give no link.
    """
    ship_code(points.sparkSession)
    points = kept(points.where("fp is not null").select("fp").distinct())
    n = points.count()
    depth = max(0, math.ceil(math.log(max(1, n / leaf_target), RING_SHARE)))
    masks, radius = block_masks(trees), max_bits // trees
    rows = _routed(points, depth, radius, masks)
    large = rows.groupBy("tree", "path").count().where(F.col("count") > leaf_rows)
    rows = rows.join(large, ["tree", "path"], "left").withColumn("chunks", F.ceil(F.coalesce("count", F.lit(1)) / leaf_rows))
    rows = rows.withColumn("chunk", F.expr("pmod(xxhash64(fp, 7), chunks)"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0L, chunks - 1)")))
    rows = rows.select("fp", "home", "tree", "path", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))

    def search(key, leaf):
        fp = leaf["fp"].to_numpy().view(np.uint64)
        label = leaf_links(fp, leaf["home"].to_numpy(), masks[key[0]], radius, max_bits)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        fps = leaf["fp"].to_numpy()
        return leaf.iloc[linked][["fp"]].rename(columns={"fp": "u"}).assign(v=fps[label[linked]])

    return rows.groupBy("tree", "path", "i", "j").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the smallest doc_id that
    chains of fingerprints within ``max_bits`` bits reach, itself included.

    Null and empty texts have fingerprint zero and link like any other; a
    null doc_id is kept, takes part in chains, and is never a component_id
    unless its group has no other (then null).  Repeated rows stay repeated.
    An empty table gives an empty result.
    """
    fps = kept(fingerprints(docs, words))
    roots = components(near_links(fps, max_bits))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = kept(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with
    the smallest doc_id.  All columns stay.  Rows with a null doc_id can't be
    named by a decision and are passed on; of repeated rows with the doc_id
    that stays, one is kept."""
    found = near_duplicates(docs.select("doc_id", "text"), words, max_bits)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    rows = docs.join(stay, docs["doc_id"].cast("long") == stay["_stay"], "left_semi").dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where("doc_id is null"))


def hex_fingerprint(name: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(name))), 16, "0")


