"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together.
A splitter is a key boundary.  Each round counts, over all partitions at once,
the exact bytes in equal cells of every open interval of keys, and shrinks
each open splitter's interval to the cell that holds its target; a splitter is
settled when a boundary meets the tolerance, or when its cell is a single row.
A hash that holds more bytes than the tolerance (a hot group of copies) is cut
further by doc_id in the same way.  Rows are then exchanged once, by piece: a
shard is cut in pieces by more splitters of the same kind, so that no task
sorts a whole shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.llm.common import constant, kept, ship_code, slots, text_or_empty

CELLS = 1 << 16        # most cells that a round brings to the driver, for all intervals together
INTERVALS = 1 << 12    # most intervals that a round counts; further ones wait for the next
PIECE_TOLERANCE = 0.1  # of a piece's bytes, for splitters inside a shard
_BIAS = 1 << 63        # longs plus this are 0 .. 2**64 - 1, in the same order
_TOP = 1 << 64


class _Open:
    """A splitter still sought: the key whose preceding bytes reach ``target``."""

    def __init__(self, target: int, tolerance: int):
        self.target, self.tolerance = target, tolerance
        self.group: int | None = None  # the hash being cut by doc_id
        self.low, self.high, self.below = 0, _TOP, 0

    def interval(self):
        return self.group, self.low, self.high


def splitters(sizes: DataFrame, targets: list[int], tolerances: list[int]) -> list[tuple[int, int]]:
    """Sorted boundaries ``(hash, id)``, biased to unsigned, one for each
    target: the rows with a smaller key hold ``target`` bytes within the
    tolerance, or as near as a whole row allows.  ``sizes(_hash, _id, _size)``.
    """
    found: dict[int, tuple[int, int]] = {}
    open_ = {k: _Open(t, e) for k, (t, e) in enumerate(zip(targets, tolerances))}
    while open_:
        spans = sorted({o.interval() for o in open_.values()}, key=lambda x: (x[0] is not None, x))[:INTERVALS]
        place = {span: k for k, span in enumerate(spans)}
        bits = (CELLS // len(spans)).bit_length() - 1
        shift = [max(0, (high - low - 1).bit_length() - bits) for _, low, high in spans]
        cells = _counts(sizes, spans, shift, bits)
        for k, o in list(open_.items()):
            if (at := place.get(o.interval())) is None:
                continue
            if (key := _narrow(o, cells.get(at, []), shift[at])) is not None:
                found[k] = key
                del open_[k]
    return sorted(found.values())


def _counts(sizes: DataFrame, spans: list, shift: list[int], bits: int) -> dict:
    """For each interval its cells with rows, in order: ``(cell, bytes, rows,
    least and greatest key, least and greatest id)``; one pass over ``sizes``."""
    u = lambda x: np.array(x, np.uint64)
    plain = [k for k, s in enumerate(spans) if s[0] is None]
    grouped: dict[int, list[int]] = {}
    for k, s in enumerate(spans):
        if s[0] is not None:
            grouped.setdefault(s[0], []).append(k)

    def cells_of(keys, of):
        """Interval (or -1) and cell of each key; the intervals don't overlap."""
        low, high = u([spans[k][1] for k in of]), u([spans[k][2] - 1 for k in of])
        at = np.searchsorted(low, keys, "right") - 1
        ok = (at >= 0) & (keys <= high[at])
        cell = (keys - low[at]) >> u([shift[k] for k in of])[at]
        return np.where(ok, np.array(of)[at] << bits | cell.astype(np.int64), -1)

    def run(batches):
        for b in batches:
            h, i = (b.column(c).to_numpy().view(np.uint64) ^ np.uint64(_BIAS) for c in (0, 1))
            size = b.column(2).to_numpy()
            parts = [(cells_of(h, plain), h)] if plain else []
            for g, of in grouped.items():
                parts.append((np.where(h == np.uint64(g), cells_of(i, of), -1), i))
            for cell, key in parts:
                rows = np.flatnonzero(cell >= 0)
                rows = rows[np.argsort(cell[rows], kind="stable")]
                if not len(rows):
                    continue
                at = np.flatnonzero(np.diff(cell[rows], prepend=-1))
                long = lambda x: pa.array((x ^ np.uint64(_BIAS)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[rows][at]), pa.array(np.add.reduceat(size[rows], at)), pa.array(np.diff(at, append=len(rows)).astype(np.int64)),
                     *[long(f.reduceat(x[rows], at)) for x in (key, i) for f in (np.minimum, np.maximum)]],
                    ["cell", "bytes", "n", "k0", "k1", "i0", "i1"])

    ship_code(sizes.sparkSession)
    counted = sizes.select("_hash", "_id", "_size").mapInArrow(run, "cell long, bytes long, n long, k0 long, k1 long, i0 long, i1 long")
    counted = counted.groupBy("cell").agg(F.sum("bytes"), F.sum("n"), F.min("k0"), F.max("k1"), F.min("i0"), F.max("i1")).orderBy("cell")
    out: dict[int, list] = {}
    for cell, size, n, *keys in counted.toPandas().itertuples(index=False):
        out.setdefault(int(cell) >> bits, []).append((int(cell) & ((1 << bits) - 1), int(size), int(n), *[int(k) + _BIAS for k in keys]))
    return out


def _narrow(o: _Open, cells: list, shift: int) -> tuple[int, int] | None:
    """The boundary of a splitter if it is settled; else its interval shrinks
    to what the cell with its target holds."""
    def boundary(key):
        if o.group is None:
            return min(key, _TOP - 1), 0
        return (o.group, key) if key < _TOP else (min(o.group + 1, _TOP - 1), 0)

    below = o.below
    for _, size, n, k0, k1, i0, i1 in cells:
        if below + size < o.target:
            below += size
            continue
        before, after = o.target - below, below + size - o.target
        if min(before, after) <= o.tolerance or n == 1 or (o.group is not None and k0 == k1):
            return boundary(k0 if before <= after else k1 + 1)
        if k0 < k1:
            o.low, o.high = k0, k1 + 1
        elif i0 == i1:  # repeats of one row are one key
            return boundary(k0 if before <= after else k1 + 1)
        else:
            o.group, o.low, o.high = k0, i0, i1 + 1
        o.below = below
        return None
    return boundary(o.high)


def _piece(cuts: list[tuple[int, int]], hash_: str = "_hash", id_: str = "_id") -> Column:
    """How many of the sorted cuts are at or below a row's key, found in two
    steps over blocks of cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    cuts = [(h - _BIAS, i - _BIAS) for h, i in cuts]

    def literal(rows):
        return constant([{"h": h, "i": i} for h, i in rows], "array<struct<h:bigint,i:bigint>>")

    def reached(rows):
        return F.size(F.filter(rows, lambda c: (c["h"] < F.col(hash_)) | ((c["h"] == F.col(hash_)) & (c["i"] <= F.col(id_)))))

    block = reached(literal(cuts[::step]))
    return F.when(block == 0, 0).otherwise((block - 1) * step + reached(F.slice(literal(cuts), (block - 1) * step + 1, step)))


def shards(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, pieces: int | None = None) -> DataFrame:
    """``docs`` with ``size, shard, slot``: all rows dealt to ``n_shards`` runs
    of keys with near equal bytes, in slots without gaps from 0.

    Size: UTF-8 bytes of the text (null: none) plus 1.  Each splitter is within
    ``tolerance`` of a shard's share of the bytes of its target, or else as
    near as a whole row allows; rows with equal doc_id and text are one key.
    Equal texts share a shard unless a splitter has to cut their group, which
    it does by doc_id.  A null doc_id sorts first; other columns stay, whatever
    their names, but ones named like the three new columns are replaced.  With
    fewer rows than shards some shards have no row; an empty table gives an
    empty result.  ``pieces`` of a shard: from the session's shuffle partitions.
    """
    text = text_or_empty()
    tag = "_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    hash_, id_, size, at, rank = (f"{tag}{c}" for c in ("hash", "id", "size", "piece", "rank"))
    keyed = docs.withColumns({hash_: F.xxhash64(text), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-_BIAS).cast("long")),
                              size: (F.octet_length(text) + 1).cast("long")})
    sizes = kept(keyed.select(F.col(hash_).alias("_hash"), F.col(id_).alias("_id"), F.col(size).alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    pieces = pieces or max(1, -(-4 * slots(docs.sparkSession) // n_shards))
    n = n_shards * pieces
    near = [int(tolerance * total / n_shards) if k % pieces == 0 else int(PIECE_TOLERANCE * total / n) for k in range(1, n)]
    cuts = splitters(sizes, [total * k // n for k in range(1, n)], near) if total else []

    # the one exchange; slots follow from the exact row counts of the pieces
    counts = {r["p"]: r["n"] for r in sizes.groupBy(_piece(cuts).alias("p")).agg(F.count("*").alias("n")).collect()}
    before = [0] * n
    for p in range(n):
        if p % pieces:
            before[p] = before[p - 1] + counts.get(p - 1, 0)
    rows = keyed.withColumn(at, _piece(cuts, hash_, id_))
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(at).orderBy(hash_, id_)) - 1)
    slot = F.element_at(constant(before, "array<bigint>"), F.col(at) + 1) + F.col(rank)
    return rows.withColumns({"size": F.col(size), "shard": F.floor(F.col(at) / pieces).cast("int"), "slot": slot}).drop(hash_, id_, size, at, rank)
