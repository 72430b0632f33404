"""Near-duplicate documents by min-max hashing over word shingles.

Under each random permutation of the shingles a document keeps both its least
and its greatest value.  Each of the two agrees between two documents with a
probability of their Jaccard similarity, so half the hash evaluations give a
signature of the same length, and as least and greatest can't fall on the same
shingle the estimate has the lower variance.  A band is the minima and maxima
of a few permutations; documents that share a band are candidates, and every
link is confirmed on the whole shingle sets.

With ``PERMUTATIONS`` and ``PER_BAND`` as set, a pair at a similarity of 0.8
shares no band with a probability of 5e-6, one at 0.85 with 1e-8.

Documents with equal sets are one class and only its representative is
banded.  A bucket may hold a large share of all classes, so its pairs are not
listed: every class is first held against one class of its buckets, drawn anew
each time, what links is contracted, and only classes of a bucket that are still apart are
compared with each other, in blocks of a bounded size.  A block compares 32 bits
of every shingle and hands on a forest that spans what it found alike.  If all
of its pairs are confirmed, what it withheld joins nothing more; else this goes
on, with more forests each time, until no block withholds a pair: no bucket is
cut short.

A class also keeps a bitmap of its shingles, four bits or more to a shingle.
A bit that only one of two sets has stands for a shingle that the other lacks,
so the bitmaps bound the intersection from above; pairs that this bound
excludes never fetch their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, text_or_empty
from flowmatch.llm.components import contracted

PERMUTATIONS = 120    # hash evaluations a shingle: twice as many signature values
PER_BAND = 3          # permutations of a band: six values
LEADER_ROUNDS = 1     # comparisons with one class of each bucket, before the rest is compared
BLOCK = 4_096         # classes of a bucket's block
BLOCK_ITEMS = 1 << 22  # shingles of a bucket's block, unless one class has more
AT_FIRST = 1          # spanning forests that a block hands on at first; eight times as many each further time
ID_BITS = 1_048_573   # remainders that tell wanted doc_ids from most others
PIECE = 1 << 20       # shingles that a task hashes at a time

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, (PERMUTATIONS // PER_BAND, 2 * PER_BAND + 1), np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct ``words``-word shingles of a text as ascending 64-bit hashes;
    of a text with fewer words its whole sequence, of none nothing."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts))] if parts else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = len(each) - words + 1
    out = each[:n].copy()
    for i in range(1, words):
        out = (out ^ (out >> np.uint64(29))) * _STEP + each[i:i + n]
    return np.unique(out)


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """Signature of each non-empty set: the minima, then the maxima, of all permutations."""
    flat = np.concatenate(sets)
    flat = ((flat ^ (flat >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for k, factor in enumerate(_FACTORS):
        values = flat * factor
        out[:, k] = np.minimum.reduceat(values, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(values, starts)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """Band keys of each signature: a 64-bit number for the band and its minima and maxima."""
    low, high = signatures[:, :PERMUTATIONS], signatures[:, PERMUTATIONS:]
    out = np.empty((len(signatures), PERMUTATIONS // PER_BAND), np.uint64)
    for b, mix in enumerate(_MIX):
        at = slice(b * PER_BAND, (b + 1) * PER_BAND)
        values = np.hstack([low[:, at], high[:, at]]).astype(np.uint64)
        key = (values * mix[:-1]).sum(axis=1, dtype=np.uint64) + mix[-1]
        out[:, b] = (key ^ (key >> np.uint64(31))) * _STEP
    return out.view(np.int64)


def bitmap(items: np.ndarray) -> bytes:
    """Which remainders the hashes of a set have, for the power of two from four times their number on."""
    bits = 1 << max(6, 2 + (len(items) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(items & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap cut down to ``size`` bytes: the remainders of a smaller power of two."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def most_common(n: int, bits: np.ndarray, others_n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of one set with others, by their bitmaps of one size (64-bit words)."""
    mine = np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64)
    theirs = np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64)
    return np.minimum(n - mine, others_n - theirs)


def _possible_with(n: np.ndarray, root: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int):
    """Of each set of a block its place, the places of the sets that its bitmap
    allows to be alike, each pair once, and their similarities at most.  Roots
    may be changed meanwhile: pairs of one root are skipped."""
    size = np.array([len(m) for m in maps])
    for s in np.unique(size):
        rows = np.flatnonzero(size >= s)
        bits = np.stack([folded(np.frombuffer(maps[r], np.uint8), int(s)) for r in rows]).view(np.uint64)
        for k in np.flatnonzero(size[rows] == s):
            r = rows[k]
            other = (root[rows] != root[r]) & ((size[rows] > s) | (rows > r)) & ((side[rows] != side[r]) | (side[r] == 2))
            other &= (100 * n[rows] >= percent * n[r]) & (100 * n[r] >= percent * n[rows])
            at = np.flatnonzero(other)
            if len(at):
                both = most_common(n[r], bits[k], n[rows[at]], bits[at])
                union = n[r] + n[rows[at]] - both
                hit = 100 * both >= percent * union
                yield r, rows[at][hit], (both / union)[hit]


def possible_pairs(n: np.ndarray, root: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Places ``(a, b)`` of a block's sets whose roots differ and whose bitmaps
    allow the similarity, and the similarity at most.  ``side`` is 0 or 1 for
    pairs between two blocks, 2 for all pairs of one."""
    found = [(np.full(len(b), a), b, most) for a, b, most in _possible_with(n, root, maps, side, percent)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def spanning_pairs(n: np.ndarray, root: np.ndarray, short: list[np.ndarray], side: np.ndarray, percent: int,
                   most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places ``(a, b)`` of a block's sets that are alike by 32 bits of each
    shingle, and whether such pairs are withheld: of pairs whose roots differ a
    forest that spans them, of the other pairs another one, up to ``most``."""
    short = [np.unique(x) for x in short]
    maps = [bitmap(x) for x in short]
    length = np.array([len(x) for x in short])
    start = np.cumsum([0, *length[:-1]])
    values, item = np.unique(np.concatenate(short), return_inverse=True)
    seen = np.zeros(len(values), bool)
    taken: list[tuple] = []
    for _ in range(most):
        label, before, old = root.copy(), len(taken), set(taken)
        for a, others, _ in _possible_with(n, label, maps, side, percent):
            if not len(others):
                continue
            size = length[others]
            first = np.cumsum(size) - size
            seen[item[start[a]:start[a] + length[a]]] = True
            both = np.add.reduceat(seen[item[np.arange(size.sum()) + np.repeat(start[others] - first, size)]], first, dtype=np.int64)
            seen[item[start[a]:start[a] + length[a]]] = False
            both = np.minimum(n[a] - length[a], n[others] - size) + both  # shingles of the same 32 bits may all be shared
            for b in others[100 * both >= percent * (n[a] + n[others] - both)]:
                if label[a] != label[b] and (a, b) not in old:
                    taken.append((a, b))
                    label[label == label[b]] = label[a]
        if len(taken) == before:
            break
    pairs = np.array(taken, int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], len(taken) > before


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, set_key, bands, bitmap)`` of every row of
    ``docs(doc_id, text, ...)``; ``set_key`` is a 128-bit digest of the set.  A
    text without words has no shingles and no bands."""
    def run(batches):
        for b in batches:
            ids, sets, size = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc_id)
                sets.append(shingles(text, words))
                size += len(sets[-1])
                if size > PIECE:
                    yield batch(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield batch(ids, sets)

    def batch(ids, sets):
        keys = [[] for _ in sets]
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            for i, row in zip(full, bands(min_max([sets[i] for i in full]))):
                keys[i] = row
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
             pa.array([bitmap(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "bitmap"])

    ship_code(docs.sparkSession)
    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, bitmap binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(node, items)`` of the classes ``wanted(node, first, set_key)``, from
    their first documents' texts: ``items`` are the ascending hashes as bytes."""
    def run(batches):
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc_id is None or wanted_bits[doc_id % ID_BITS]:
                    items = shingles(text, words).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(items)], pa.binary()), pa.array([items], pa.binary())], ["set_key", "items"])

    # which remainders the wanted ids have: more ids only let more texts through to the join
    wanted_bits = np.zeros(ID_BITS, bool)
    wanted_bits[[r.bit for r in wanted.select(F.pmod("first", F.lit(ID_BITS)).alias("bit")).distinct().collect() if r.bit is not None]] = True
    rows = _texts(docs).mapInArrow(run, "set_key binary, items binary")
    return rows.groupBy("set_key").agg(F.first("items").alias("items")).join(wanted, "set_key").select("node", "items")


def _checked(pairs: DataFrame, values: DataFrame, test) -> DataFrame:
    """Those of ``pairs(a, b, n_a, n_b)`` for which ``test`` holds of n_a, n_b
    and the ``items`` that ``values(node, items)`` has for a and b, checkpointed.

    A class that many pairs share skews the join on it: adaptive execution
    splits the pairs, whose rows are narrow at that join."""
    def run(batches):
        for batch in batches:
            hit = pa.array([test(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in range(4)], ["a", "b", "n_a", "n_b"])

    both = pairs.join(values.select(F.col("node").alias("a"), F.col("items").alias("of_a")), "a")
    both = both.join(values.select(F.col("node").alias("b"), F.col("items").alias("of_b")), "b")
    return kept(both.select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(run, "a long, b long, n_a long, n_b long"))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that the bitmaps don't exclude."""
    def test(n, m, x, y):
        x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
        size = min(len(x), len(y))
        most = int(most_common(n, folded(x, size).view(np.uint64), np.array([m]), folded(y, size).view(np.uint64)[None])[0])
        return 100 * most >= percent * (n + m - most)

    return _checked(pairs, classes.select("node", F.col("bitmap").alias("items")), test)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose whole sets have the similarity, as ``(u, v)``."""
    def test(n, m, x, y):
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
        return 100 * both >= percent * (n + m - both)

    return _checked(pairs, sets, test).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _between_components(members: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """``(a, b, n_a, n_b, withheld)``: pairs of classes that share a bucket, lie
    in different components and are alike by 32 bits of each shingle.  A bucket
    is compared in blocks; a block hands on ``most`` spanning forests, so never
    more pairs than it has rows times ``most``, and says whether it withholds
    any (on each pair's row), checkpointed."""
    def shortened(batches):
        for b in batches:
            items = [np.frombuffer(x, np.uint64).astype(np.uint32).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], ["node", "short"])

    blocks = members.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).alias("blocks"))
    rows = members.join(blocks, "band").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    rows = rows.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1))
    rows = rows.join(sets.mapInArrow(shortened, "node long, short binary"), "node").select("band", "i", "j", "side", "node", "root", "n", "short")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")  # by node: buckets choose the same pairs

    def compare(group):
        node, root, n = (group.column(c).to_numpy() for c in ("node", "root", "n"))
        short = [np.frombuffer(x, np.uint32) for x in group.column("short").to_pylist()]
        a, b, withheld = spanning_pairs(n, root, short, group.column("side").to_numpy(), percent, most)
        if not len(a):
            return None
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[a], node[b], n[a], n[b], np.full(len(a), withheld))], ["a", "b", "n_a", "n_b", "withheld"])

    def run(batches):
        left = None  # the last group of a batch may go on in the next one
        for batch in batches:
            part = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            keys = np.stack([part.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for at, to in zip([0, *cuts[:-1]], cuts):
                if (out := compare(part.slice(at, to - at))) is not None:
                    yield out
            (left,) = part.slice(cuts[-1] if len(cuts) else 0).to_batches() or [None]
        if left is not None and (out := compare(pa.Table.from_batches([left]))) is not None:
            yield out

    return kept(dealt.mapInArrow(run, "a long, b long, n_a long, n_b long, withheld boolean"))


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` of buckets that still hold classes of several components, with their ``root``."""
    roots = contracted(links).withColumnRenamed("root", "to")
    rows = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")
    open_ = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rows.join(open_.select("band"), "band")


def near_links(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` that span every component of the classes ``(node,
    first, set_key, n_shingles, bands, bitmap)`` joined by sets of the similarity."""
    buckets = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").count().where("count > 1").select("band")
    members = kept(buckets.join(shared, "band").withColumn("root", F.col("node")))
    wanted = kept(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first", "set_key"))
    sets = kept(_sets(docs, wanted, words))
    alike = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")  # else the sizes alone exclude it
    links = None
    for turn in range(LEADER_ROUNDS):
        drawn = F.struct(F.xxhash64(F.lit(turn), "band", "node").alias("draw"), "node", "n", "root")
        heads = members.groupBy("band").agg(F.min(drawn).alias("head"))
        near = members.join(heads, "band").where(F.col("root") != F.col("head.root")).select(
            F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b")).where(alike)
        # of the classes drawn in a class's buckets one
        one = F.min(F.struct(F.xxhash64(F.lit(turn), "a", "b").alias("draw"), "a", "n_a", "n_b")).alias("p")
        pairs = near.groupBy("b").agg(one).select("p.a", "b", "p.n_a", "p.n_b")
        found = _confirmed(_possible(pairs, classes, percent), sets, percent)
        links = found if links is None else links.unionByName(found)
        members = kept(_rooted(members, links))
    most = AT_FIRST
    while True:
        pairs = _between_components(members, sets, percent, most)
        asked = kept(pairs.drop("withheld").distinct())
        found = _confirmed(asked, sets, percent)
        links = links.unionByName(found)
        # what a forest withholds is moot if all of it is confirmed; elsewhere more pairs come
        if not pairs.agg(F.max("withheld")).first()[0] or found.count() == asked.count():
            return links
        members, most = kept(_rooted(members, links)), 8 * most


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of
    ``docs(doc_id, text, ...)``.

    Documents are linked if their sets of distinct ``words``-word shingles
    (of a text with fewer words: its whole sequence) have ``100 * intersection
    >= percent * union``; ``component_id`` is the smallest doc_id reachable,
    itself included, ``kept`` whether it is the row's own.  Shingles are
    compared by 64-bit hashes.

    A null text counts as empty; a text without words is linked with nothing
    and is its own component.  Repeated rows stay repeated and are linked.  A
    row with a null doc_id takes part; its component_id is null and it is kept
    only if nothing that it is linked with has a doc_id.  Other columns are
    left out, whatever their names; an empty table stays empty.
    """
    rows = kept(signatures(docs, words))
    groups = rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("bitmap").alias("bitmap"))
    classes = kept(groups.withColumn("node", F.monotonically_increasing_id()))
    roots = contracted(near_links(classes, docs, words, percent))
    rooted = classes.select("node", "first", "set_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("set_key", "component_id")
    found = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
