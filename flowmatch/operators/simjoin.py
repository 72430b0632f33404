"""Threshold joins of labels: all pairs of similar labels, without scoring all
pairs (L8, L9, and any other ``similarity_func``).

A similarity here is a function ``(left, right, threshold) -> (l1, l2, score)``
of two tables of distinct labels ``(l1)`` and ``(l2)``; it returns exactly the
pairs with ``score >= threshold``.  ``score_pairs`` takes one.

``by_cosine`` compares unit vectors.  Rows lie in cells about pivots; by the
triangle inequality of angles two cells whose pivots are further apart than
their radii and the threshold's angle together hold no pair.  In what is left
the products of the first dimensions are summed in single precision: what the
remaining dimensions can add is at most the product of the remaining norms, so
most pairs are dropped before their product is whole.  The scores of the pairs
found are summed in double precision.  Cells go to tasks in bundles: a row is
copied once for each bundle that it may meet, not for each cell, and there are
no more bundles than the slots ask for or ``BUNDLE`` forces.

``by_edits`` compares strings by ``1 - edits / longer length``.  A string is
indexed by its rarest q-grams, as many as the allowed edits can destroy and one
more: a pair within them shares one of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.session import cut_lineage, ship_by_value

PIVOTS = 64          # most cells, and most rows that come to the driver
CELL_ROWS = 2_048    # rows for each further cell
CHUNK = 4_096        # least rows of a bundle
BUNDLE = 65_536      # most rows of a side that one task holds
TILE = 512           # rows of a side whose products are made at a time; they stay in the processor's cache
STEP = 8             # steps of the number of dimensions summed for every pair
PROBED = 512         # rows of a side on which that number is tried, which decides on speed only
OPEN = 1 / 128       # most of those pairs that it may leave open
SCORED = 16_384      # found pairs whose scores are summed at a time
TASKS = 4_096        # most partitions of pairs of bundles

Similarity = Callable[[DataFrame, DataFrame, float], DataFrame]


def _units(df: DataFrame, vector: str) -> DataFrame:
    """``(label, v, norm)``: vectors as doubles; null, zero or broken ones have no similarity."""
    v = df.select("label", F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    v = v.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return v.where(~F.isnan("norm"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each list of doubles; missing dimensions are 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out, sizes = np.zeros((len(vectors), width)), vectors.value_lengths().to_numpy()
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def _unit(rows: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    return _matrix(rows.column("v"), width) / rows.column("norm").to_numpy()[:, None]


class _Cut:
    """Unit vectors in single precision, cut behind ``head`` dimensions: their
    first dimensions and the norm of the others, whose product is the most that
    the whole product of two can be; a further step; and what is left."""

    def __init__(self, unit: np.ndarray, head: int):
        rest = [np.sqrt(np.square(unit[:, k:]).sum(axis=1)).astype(np.float32) for k in (head, head + STEP)]
        self.first = np.concatenate([unit[:, :head], rest[0][:, None]], axis=1, dtype=np.float32, casting="same_kind")
        self.step, self.last = (unit[:, k].astype(np.float32) for k in (slice(head, head + STEP), slice(head + STEP, None)))
        self.rest = rest


def _head(x: np.ndarray, y: np.ndarray, least: float) -> int:
    """How many dimensions to sum of every pair: as few as leave few of some pairs open."""
    x, y = (u[np.linspace(0, len(u) - 1, min(len(u), PROBED)).astype(int)] for u in (x, y))
    width = x.shape[1]
    for head in range(STEP, width, STEP):
        a, b = _Cut(x, head), _Cut(y, head)
        if (a.first @ b.first.T >= least).mean() <= OPEN:
            return head
    return width


def near_products(x: np.ndarray, y: np.ndarray, threshold: float, places=None, ascending: bool = False):
    """Yield ``(i, j, n)``: places of rows of ``x`` and ``y`` (unit vectors)
    whose product may reach the threshold, and how many pairs had their whole
    product summed for these.  ``places`` are pairs of slices of ``x`` and ``y``
    that are compared, by default all of both; ``ascending`` leaves out ``j < i``.
    A margin for single precision keeps rounding from dropping a pair."""
    width = x.shape[1]
    least = np.float32(threshold - 1e-9 - (width + 8) * 2.0 ** -22)
    head = _head(x, y, least) if len(x) and len(y) else width
    a, b = _Cut(x, head), _Cut(y, head)
    most = np.empty((TILE, TILE), np.float32)
    open_ = np.zeros((TILE, TILE), bool)
    for rows, columns in places or [(slice(0, len(x)), slice(0, len(y)))]:
        for r in range(rows.start, rows.stop, TILE):
            for s in range(columns.start, columns.stop, TILE):
                one, two = a.first[r:min(r + TILE, rows.stop)], b.first[s:min(s + TILE, columns.stop)]
                if ascending and s + len(two) <= r:
                    continue
                tile = most[:len(one), :len(two)]
                np.matmul(one, two.T, out=tile)
                if tile.shape != most.shape:
                    open_[:] = False
                np.greater_equal(tile, least, out=open_[:len(one), :len(two)])
                eights = np.flatnonzero(open_.view(np.uint64))  # few are open: eight are passed over at a time
                eight, at = np.nonzero(open_.reshape(-1, 8)[eights])
                i, j = np.divmod(eights[eight] * 8 + at, TILE)
                if ascending:
                    i, j = i[i + r <= j + s], j[i + r <= j + s]
                if head == width:
                    yield i + r, j + s, tile.size
                    continue
                so_far = most[i, j]
                i, j = i + r, j + s
                so_far += np.einsum("kd,kd->k", a.step[i], b.step[j]) - a.rest[0][i] * b.rest[0][j]
                open_still = so_far + a.rest[1][i] * b.rest[1][j] >= least
                i, j, so_far = i[open_still], j[open_still], so_far[open_still]
                n = len(i)
                hit = so_far + np.einsum("kd,kd->k", a.last[i], b.last[j]) >= least
                yield i[hit], j[hit], n


def _places(a: pa.Table, b: pa.Table, others_of: dict[int, np.ndarray]):
    """Slices of rows of two tables, each in order of its cells, that may meet."""
    cell_a, cell_b = a.column("cell").to_numpy(), b.column("cell").to_numpy()
    edge = lambda cells: {int(cells[k]): k for k in np.flatnonzero(np.diff(cells, prepend=-1))}
    begins, end = edge(cell_a), list(edge(cell_a).values())[1:] + [len(cell_a)]
    for (g, r), to in zip(begins.items(), end):
        # neighbouring cells are one slice
        near = np.flatnonzero(np.diff(np.isin(cell_b, others_of.get(g, [])), prepend=False, append=False))
        for s, t in near.reshape(-1, 2):
            yield slice(r, to), slice(int(s), int(t))


def _cells(df: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``(label, v, norm, cell, angle)``: the nearest pivot of each row and the angle to it."""
    def run(batches):
        for b in batches:
            cosines = np.clip(_unit(b, width) @ pivots.T, -1, 1)
            cell = cosines.argmax(axis=1)
            angle = np.arccos(cosines[np.arange(b.num_rows), cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    ship_by_value(__name__)
    return df.mapInArrow(run, "label string, v array<double>, norm double, cell int, angle double")


def _bundles(rows: dict[int, int], between: np.ndarray, most: int) -> dict[int, list[int]]:
    """The bundles of each cell: cells near each other fill one of ``most`` rows
    together, a larger cell is dealt over several of its own."""
    out, bundle, filled = {}, -1, most
    left, at = dict(rows), None
    while left:
        at = min(left, key=lambda c: (0 if at is None else between[at, c], c))
        n = left.pop(at)
        if n > most:
            parts = math.ceil(n / most)
            out[at] = list(range(bundle + 1, bundle + 1 + parts))
            bundle, filled = bundle + parts, most
            continue
        if filled + n > most:
            bundle, filled = bundle + 1, 0
        out[at], filled = [bundle], filled + n
    return out


def _even_keys(spark, n: int) -> list[int]:
    """``n`` keys that hash partitioning puts in as many partitions, one in each
    (beyond ``TASKS`` any keys, as each partition has several)."""
    if n > TASKS:
        return list(range(n))
    ids = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("id"))
    first = {r.at: r.id for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()}
    return [first.get(k, -1 - k) for k in range(n)]


def _scores(x: np.ndarray, y: np.ndarray, norm_x: np.ndarray, norm_y: np.ndarray) -> np.ndarray:
    """Cosines of the rows, their products summed from left to right as ``cosine`` does."""
    return np.add.accumulate(x * y, axis=1)[:, -1] / (norm_x * norm_y)


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(l1, l2, score, scored)`` of all pairs of ``left(label, vector)`` and
    ``right(label, vector)`` with a cosine of at least ``threshold`` (> -1).

    ``scored`` is the number of pairs whose whole product the pair's task
    summed, for tests and tuning.  Labels are taken as distinct; vectors that
    are null, zero or not finite are similar to none; missing dimensions are 0.

    Of a table joined with itself (``right is left``) each product is made once,
    for both orders of its pair."""
    spark, own = left.sparkSession, right is left
    sides = [cut_lineage(_units(side, "vector")) for side in ((left,) if own else (left, right))]
    sizes = [side.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first() for side in sides]
    width, n_right = max(1, *(r[0] for r in sizes)), sizes[-1][1]
    n_pivots = max(1, min(PIVOTS, n_right // CELL_ROWS))
    pivots = sides[-1].orderBy(F.xxhash64("label"), "label").limit(n_pivots).toArrow()
    pivots = _unit(pivots, width) if len(pivots) else np.eye(1, width)
    sides = [cut_lineage(_cells(side, pivots, width)) for side in sides]
    radius = [{r.cell: (r.angle, r.n) for r in side.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}
              for side in sides]
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    met = {(i, j) for i, (a, _) in radius[0].items() for j, (b, _) in radius[-1].items() if min(between[i, j], between[j, i]) <= a + b + reach}
    others_of = {i: np.array(sorted(k for g, k in met if g == i)) for i, _ in met}
    # bundles of a side, for enough tasks; of a table with itself half the pairs of bundles are left
    wanted = math.ceil(math.sqrt((8 if own else 4) * spark.sparkContext.defaultParallelism))
    rows_of = [{c: n for c, (_, n) in side.items()} for side in radius]
    bundles = [_bundles(of, between, max(CHUNK, min(BUNDLE, math.ceil(sum(of.values()) / wanted)))) for of in rows_of]
    meets = sorted({(g, h) for i, j in met for g in bundles[0][i] for h in bundles[-1][j] if not own or g <= h})
    tasks = _even_keys(spark, len(meets)) if meets else []
    n_tasks, dealt = max(1, min(len(tasks), TASKS)), []
    for k in range(2):
        side, of = sides[k % len(sides)], bundles[k % len(sides)]
        parts = spark.createDataFrame([(c, len(b), b) for c, b in of.items()], "cell int, n int, parts array<int>")  # a row for each cell
        others: dict[int, list] = {}
        for task, (g, h) in zip(tasks, meets):
            if not (own and k and g == h):  # a bundle meets itself in one copy
                others.setdefault((g, h)[k], []).append((task, own and g == h))
        pairs = spark.createDataFrame(list(others.items()), "bundle int, others array<struct<task int, same boolean>>")  # a row for each bundle
        mined = side.join(F.broadcast(parts), "cell").withColumn("bundle", F.get("parts", F.pmod(F.xxhash64("label"), F.col("n")).cast("int")))
        copies = mined.join(F.broadcast(pairs), "bundle").select("label", "v", "norm", "cell", F.explode("others").alias("other"))
        copies = copies.select("label", "v", "norm", "cell", "other.same", "other.task")
        # the number of partitions is fixed, as the bytes of the rows don't tell how many pairs they are
        dealt.append(copies.toDF(*copies.columns).repartition(n_tasks, "task"))  # columns of its own: both may be of one table
    one, two = dealt

    def compare(a, b):
        same = len(a) > 0 and a.column("same")[0].as_py()
        b = a if same else b
        found, scored = [[], []], 0
        a, b = (t.take(pa.array(np.argsort(t.column("cell").to_numpy(), kind="stable"))) for t in (a, b))  # a cell's rows together
        if len(a) and len(b):
            u, v = (_matrix(t.column("v"), width) for t in (a, b))
            norm_u, norm_v = a.column("norm").to_numpy(), b.column("norm").to_numpy()
            for i, j, n in near_products(u / norm_u[:, None], v / norm_v[:, None], threshold, _places(a, b, others_of), same):
                scored += n
                for k in range(0, len(i), SCORED):
                    m, o = i[k:k + SCORED], j[k:k + SCORED]
                    score = _scores(u[m], v[o], norm_u[m], norm_v[o])
                    hit = score >= threshold
                    found[0].append((m[hit], o[hit]))
                    found[1].append(score[hit])
        i, j = (np.concatenate(c) for c in zip(*found[0])) if found[0] else (np.zeros(0, int), np.zeros(0, int))
        score = np.concatenate(found[1]) if found[1] else np.zeros(0)
        twice = np.logical_not(same & (i == j)) if own else np.zeros(len(i), bool)  # a row with itself has one order
        return pa.table([a.column("label").take(pa.array(i)), b.column("label").take(pa.array(j)), pa.array(score),
                         pa.array(np.full(len(i), scored, np.int64)), pa.array(twice)], names=["l1", "l2", "score", "scored", "twice"])

    out = one.groupBy("task").cogroup(two.groupBy("task")).applyInArrow(compare, "l1 string, l2 string, score double, scored long, twice boolean")
    if not own:
        return out.drop("twice")
    orders = F.when(F.col("twice"), F.array(F.struct("l1", "l2"), F.struct(F.col("l2").alias("l1"), F.col("l1").alias("l2")))).otherwise(F.array(F.struct("l1", "l2")))
    return out.select(F.inline(orders), "score", "scored").select("l1", "l2", "score", "scored")


def by_cosine(vectors: DataFrame) -> Similarity:
    """Cosine of label vectors ``(label, vector)``, one for each distinct label;
    a label without a vector is similar to none."""
    def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
        v = vectors.select("label", "vector").dropDuplicates(["label"])
        return cosine_join(left.select(F.col("l1").alias("label")).join(v, "label"),
                           right.select(F.col("l2").alias("label")).join(v, "label"), threshold).drop("scored")
    return similar


def _indexed(labels: DataFrame, threshold: float, q: int, counts: DataFrame | None = None) -> DataFrame:
    """``(label, gram, ring)``: the grams that stand for each label, and its ring of lengths."""
    n = F.length("label")
    grams = F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring("label", i, F.lit(q))))).otherwise(F.array().cast("array<string>"))
    # edits of a pair with this label, whose longer string has up to n / threshold letters
    edits = F.floor((1 - threshold) * n / threshold + 1e-9)
    rows = labels.select("label", n.alias("n"), grams.alias("grams"), (edits * q + 1).alias("take"))
    # a label with too few grams also stands under each of its letters: two such labels share one
    letters = F.when(F.size("grams") < F.col("take"), F.array_distinct(F.split("label", ""))).otherwise(F.array().cast("array<string>"))
    letters = rows.select("label", "n", F.explode(F.filter(letters, lambda c: c != "")).alias("gram"), F.lit(True).alias("letter"))
    each = rows.select("label", "n", "take", F.explode("grams").alias("gram"))
    each = each.join(counts, "gram", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram")))
    each = each.groupBy("label", "n", "take").agg(order.alias("o")).select("label", "n", F.explode(F.slice("o", 1, F.col("take").cast("int"))).alias("g"))
    both = each.select("label", "n", F.col("g.gram").alias("gram"), F.lit(False).alias("letter")).unionByName(letters)
    return both.withColumn("ring", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / threshold) + 1e-9).cast("int"))


def by_edits(q: int = 2) -> Similarity:
    """``1 - edits / longer length`` of two strings (equal strings: 1), for
    thresholds above 0 and below 1 or equal to it."""
    def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        one, two = left.select(F.col("l1").alias("label")).distinct(), right.select(F.col("l2").alias("label")).distinct()
        equal = one.join(two, "label").select(F.col("label").alias("l1"), F.col("label").alias("l2"), F.lit(1.0).alias("score"))
        if threshold == 1:
            return equal
        n = F.length("label")
        grams = F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring("label", i, F.lit(q)))))
        counts = one.unionByName(two).select(F.explode(grams).alias("gram")).groupBy("gram").count()
        a = _indexed(one, threshold, q, counts).withColumnsRenamed({"label": "l1", "n": "n1"})
        # lengths within the threshold lie in the same or in neighbouring rings
        b = _indexed(two, threshold, q, counts).withColumnsRenamed({"label": "l2", "n": "n2"})
        b = b.withColumn("ring", F.explode(F.array(F.col("ring") - 1, "ring", F.col("ring") + 1)))
        pairs = a.join(b, ["gram", "letter", "ring"]).where(
            (F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-9) & (F.col("l1") != F.col("l2")))
        pairs = pairs.select("l1", "l2").distinct()
        longer = F.greatest(F.length("l1"), F.length("l2"))
        pairs = pairs.withColumn("score", 1 - F.levenshtein("l1", "l2") / longer)
        return pairs.where(F.col("score") >= threshold).unionByName(equal)
    return similar
