"""Hard negatives by Four-Russians scoring of integer vectors.

An anchor's dimensions are taken in groups of eight.  For each group a table
holds the sum of every subset of its eight components.  A candidate is held as
bit planes in two's complement: for each plane and each group one byte says
which of the eight components have that bit.  The byte picks the subset sum,
so one lookup scores eight dimensions of one plane, and the planes' sums,
shifted and added from the sign plane down, are the full, exact inner product.

The stated anchors meet all rows in a grid of blocks of bounded size.  Rows of
the anchor's label are scored once, for its positives, and all others once,
for its negatives; each cell of the grid hands on no more than the best of
each list, which is exact, as the best of all are among them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, slots

ANCHOR_BLOCK = 4_096   # anchors of a cell, about
ROW_BLOCK = 16_384     # rows of a cell, about
TABLES = 64            # anchors whose tables stand in memory together
SCALE = 256            # components become floor(SCALE * x)


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """``(planes, groups, rows)`` bytes of integer vectors ``(rows, 8 * groups)``;
    the last plane is the sign."""
    bits = np.stack([(vectors >> b) & 1 for b in range(planes)]).astype(np.uint8)
    packed = np.packbits(bits, axis=2, bitorder="little")
    return np.ascontiguousarray(packed.transpose(0, 2, 1))


def subset_sums(vectors: np.ndarray, dtype) -> np.ndarray:
    """``(groups, 256, rows)``: sums of all subsets of each eight components."""
    rows, dims = vectors.shape
    parts = vectors.reshape(rows, dims // 8, 8).transpose(1, 2, 0).astype(dtype)
    out = np.zeros((dims // 8, 256, rows), dtype)
    for k in range(8):
        np.add(out[:, :1 << k], parts[:, k:k + 1], out=out[:, 1 << k:2 << k])
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(rows, anchors)`` inner products from the anchors' tables and the rows' planes."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        total <<= 1
        for table, byte in zip(tables, planes[b]):
            np.take(table, byte, axis=0, out=found, mode="clip")
            if b == len(planes) - 1:
                total -= found
            else:
                total += found
    return total


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the rows ``at`` by descending score, ties in order."""
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        above, ties = at[score[at] > least], at[score[at] == least]
        at = np.concatenate([above, ties[:k - len(above)]])
    return at[np.argsort(-score[at], kind="stable")]


def vectors(embeddings: DataFrame, folds: bool = True) -> DataFrame:
    """``(row, vec_id, label, vec)`` of the rows that take part: integer
    components padded with zeros to one length, checkpointed.

    A row with a null vec_id, label or vector, or with a null or non-finite
    component, takes no part; fully repeated rows are one.  With ``folds`` the
    label of rows whose vec_id is divisible by 7 becomes (label + 1) % 10.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(fine)
    if folds:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(SCALE * x).cast("long"))).distinct()
    return kept(rows.withColumn("row", F.monotonically_increasing_id()))


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors dealt to the cells of the grid, grouped by cell."""
    across = max(1, math.ceil(n_anchors / ANCHOR_BLOCK))
    down = max(1, math.ceil(n_rows / ROW_BLOCK), min(2 * slots(rows.sparkSession) // across, n_rows // 1024))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    right = rows.withColumn("i", deal(down)).withColumn("j", every(across))
    left = anchors.withColumn("j", deal(across)).withColumn("i", every(down))
    return right.groupBy("i", "j").cogroup(left.groupBy("i", "j"))


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(frame), width), np.int64)
    for k, v in enumerate(frame["vec"]):
        out[k, :len(v)] = v
    return out


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100,
         folds: bool = True) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: hard negatives of the anchors, the rows whose vec_id is
    divisible by ``every``.

    An anchor's positives are its first ``positives`` other rows of its label by
    score (ties by vec_id); for each the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score`` are ranked from 1.  ``vectors`` says which rows take
    part; rows of one vec_id that differ otherwise are different rows, but
    none is a positive of its own vec_id.  Other columns are left out; an
    empty table or one without anchors gives an empty result.  Scores beyond
    64 bits are an error.
    """
    spark = embeddings.sparkSession
    ship_code(spark)
    rows = vectors(embeddings, folds)
    anchors = rows.where(F.col("vec_id") % every == 0)
    longest = F.coalesce(F.max(F.size("vec")), F.lit(0))
    largest = F.max(F.greatest(F.coalesce(F.array_max("vec"), F.lit(0)), -F.coalesce(F.array_min("vec"), F.lit(0))))
    n_rows, n_anchors, dims, top = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), longest, F.coalesce(largest, F.lit(0))).first()
    width, planes = 8 * max(1, math.ceil(dims / 8)), int(top).bit_length() + 1
    if 100 * max(1, width) * int(top) ** 2 >= 1 << 62:
        raise ValueError(f"components of {top} in {dims} dimensions: scores don't fit in 64 bits")
    dtype = np.int32 if width * int(top) ** 2 < 1 << 30 else np.int64

    def cell(right, left, same, take):
        """Score a cell's anchors against its rows of the same or of other labels."""
        right, left = right.sort_values(["vec_id", "row"]), left.sort_values(["label", "row"])
        if not len(right) or not len(left):
            return
        byte, label = bit_planes(_matrix(right, width), planes), right["label"].to_numpy()
        vec = _matrix(left, width)
        for own, block in left.reset_index(drop=True).groupby("label"):
            at = np.flatnonzero((label == own) == same)
            if not len(at):
                continue
            part, part_byte = right.iloc[at], np.ascontiguousarray(byte[:, :, at])
            for k in range(0, len(block), TABLES):
                some = block.iloc[k:k + TABLES]
                found = scores(subset_sums(vec[some.index], dtype), part_byte).T.astype(np.int64)
                for (_, anchor), score in zip(some.iterrows(), found):
                    yield from take(anchor, part, np.ascontiguousarray(score))

    def best_positives(right, left):
        def take(anchor, part, score):
            at = _best(score, np.flatnonzero(part["vec_id"].to_numpy() != anchor["vec_id"]), positives)
            yield pd.DataFrame({"row": anchor["row"], "positive_row": part["row"].to_numpy()[at],
                                "positive_id": part["vec_id"].to_numpy()[at], "positive_score": score[at]})
        return _joined(cell(right, left, True, take), ["row", "positive_row", "positive_id", "positive_score"])

    def best_negatives(right, left):
        def take(anchor, part, score):
            for positive_row, positive_id, p in zip(anchor["positive_row"], anchor["positive_id"], anchor["positive_score"]):
                at = _best(score, np.flatnonzero((100 * score >= low * p) & (100 * score <= high * p)), negatives)
                if len(at):
                    yield pd.DataFrame({"anchor_id": anchor["vec_id"], "row": anchor["row"], "positive_row": positive_row,
                                        "positive_id": positive_id, "positive_score": p, "negative_row": part["row"].to_numpy()[at],
                                        "negative_id": part["vec_id"].to_numpy()[at], "negative_score": score[at]})
        return _joined(cell(right, left, False, take), ["anchor_id", "row", "positive_row", "positive_id", "positive_score", "negative_row", "negative_id", "negative_score"])

    first = _cells(rows, anchors, n_rows, n_anchors).applyInPandas(best_positives, "row long, positive_row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    # at most `positives` entries an anchor
    listed = first.groupBy("row").agg(F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("found"))
    known = kept(anchors.join(listed, "row").select(*anchors.columns, *[F.col(f"found.{c}").alias(c) for c in ("positive_row", "positive_id", "positive_score")]))
    second = _cells(rows, known, n_rows, n_anchors).applyInPandas(
        best_negatives, "anchor_id long, row long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _joined(frames, columns: list[str]) -> pd.DataFrame:
    frames = list(frames)
    return pd.concat(frames) if frames else pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})


def mine_sql(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100) -> str:
    """DuckDB SQL for ``mine`` over the view ``embeddings`` (distinct vec_ids, one vector length)."""
    return f"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM rows_ a, rows_ b WHERE a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {negatives}
"""
