"""Benchmark decontamination by winnowing.

Of the ``window - gram + 1`` hashes of ``gram`` words in each window of
``window`` words the smallest is kept, on both sides: it is the window's
fingerprint.  Two texts that share ``window`` words in a row keep the same hash
there, so every shared span of that length leaves a common fingerprint.
Fingerprints are joined and extended: a join row also needs the digest of the
whole window, so a phrase that many texts and items share, but no longer span,
joins nothing, and one that they do share joins one row of the items' windows,
however many items hold it.  Windows that overlap make up the spans.
An item with fewer words has no such window: it is one fingerprint of all its
words, looked up at every position.

Before the join, a bitmap of fixed size (``CELLS`` bits, filled from the items'
fingerprints) drops document fingerprints that no item can have; it never drops
a hit, and with many items it only lets more rows through to the join.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, text_or_empty
from flowmatch.llm.pretoken import pieces

WINDOW, GRAM = 10, 5
CELLS = 1 << 20
# ASCII other than digits and lower-case letters parts words; capitals are lowered.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_CANDIDATE = "struct<pos:int,len:int,h:bigint,span:binary>"
_CANDIDATE_ARROW = pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("h", pa.int64()), ("span", pa.binary())])


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class _Hashes(dict):
    """Word to 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, size, np.uint64)
    for j in range(size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return g


def selected(h: np.ndarray, room: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window and its fingerprint, the least of its hashes.

    ``h``: word hashes of several texts in a row; ``room``: how many words of
    its own text each word has from itself on.
    """
    g = _grams(h, gram)
    at = np.flatnonzero(room >= window)
    if not len(at):
        return at, g[:0]
    least = g[at]
    for j in range(1, window - gram + 1):
        least = np.minimum(least, g[at + j])
    return at, least


def _fingerprint_rows(window: int, gram: int, lengths: list[int], cells: bytes | None, whole: bool):
    """Task function: per text its number of words and its candidates.

    ``lengths``: word counts below ``window`` looked up at every position;
    ``whole``: only where the text has that many words (items).
    """
    bits = None if cells is None else np.frombuffer(cells, np.uint8)

    def possible(h):
        if bits is None:
            return np.ones(len(h), bool)
        cell = (h >> np.uint64(44)).astype(np.int64)
        return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1

    def candidates(texts):
        parts = [words(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        h = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
        ends = np.repeat(np.cumsum(counts), counts)
        room = ends - np.arange(len(flat))
        of = np.repeat(np.arange(len(parts)), counts)
        begin = np.cumsum(counts) - counts
        found: list[list] = [[] for _ in parts]

        def add(at, keys, size):
            keep = possible(keys)
            for p, key in zip(at[keep].tolist(), keys[keep].view(np.int64).tolist()):
                found[of[p]].append({"pos": p - begin[of[p]], "len": size, "h": key, "span": xxhash.xxh3_128_digest(b" ".join(flat[p:p + size]))})

        add(*selected(h, room, window, gram), window)
        for size in lengths:
            at = np.flatnonzero(room >= size)
            if whole:
                at = at[(at == begin[of[at]]) & (counts[of[at]] == size)]
            add(at, _grams(h, size)[at], size)
        return counts.tolist(), found

    def run(batches):
        for b in batches:
            counts, found = [], []
            for part in pieces(b.column(1).to_pylist(), 1_000_000):
                c, f = candidates(part)
                counts += c
                found += f
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_CANDIDATE_ARROW))],
                ["id", "content", "n_words", "found"])

    return run


def _candidates(df: DataFrame, id_column: str, *how) -> DataFrame:
    """``(id, content, n_words, found)``; the id keeps its type, ``content`` is a digest of the text."""
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    rows = rows.select("id", "text", F.md5("text").alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_rows(*how), f"id {kind}, content string, n_words long, found array<{_CANDIDATE}>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, content, n_words,
    n_hit, spans, items, contaminated``.

    ``items(item_id, text, ...)`` is the benchmark.  ``spans``: word ranges
    [start, end) covered by occurrences of item windows (``window`` words in
    a row of an item; all words of a shorter one); ``items``: sorted item_ids
    (as strings) that have such an occurrence; ``content``: a digest of the
    text, for joining the decision back.  Ids may be of any type.  Null texts
    have no words, texts and items without words hit nothing; null ids stay
    null and a null item_id isn't named; repeated items count once, repeated
    documents stay repeated.  Empty tables give no hits or no rows.
    """
    marks = kept(_candidates(items, "item_id", window, gram, list(range(1, window)), None, True)
                 .select(F.col("id").cast("string").alias("item"), F.inline("found")))
    # windows held by the same items are one class: a text names the items of a class once
    holders = marks.groupBy("len", "h", "span").agg(F.sort_array(F.collect_set("item")).alias("held"))
    holders = kept(holders.withColumn("class", F.md5(F.to_json("held"))))
    windows = holders.select("len", "h", "span", "class")
    named = holders.select("class", "held").dropDuplicates(["class"]).select("class", F.explode("held").alias("item"))

    # at most CELLS numbers and window - 1 lengths come to the driver
    cells = np.zeros(CELLS // 8, np.uint8)
    full = marks.select(F.shiftrightunsigned("h", 44).alias("cell")).distinct().toPandas()["cell"].to_numpy().astype(np.int64)
    np.bitwise_or.at(cells, full >> 3, (1 << (full & 7)).astype(np.uint8))
    lengths = sorted(r["len"] for r in marks.select("len").distinct().collect() if r["len"] < window)

    rows = _candidates(docs, "doc_id", window, gram, lengths, cells.tobytes(), False)
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.select("row", F.inline("found")).join(windows, ["len", "h", "span"])
    hits = kept(hits.select("row", "class", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))

    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("raw"))
    merged = F.expr("""aggregate(raw, cast(array() as array<struct<start:int,end:int>>), (out, s) ->
        if(size(out) > 0 and element_at(out, -1).end >= s.start,
           concat(slice(out, 1, size(out) - 1), array(struct(element_at(out, -1).start as start, greatest(element_at(out, -1).end, s.end) as end))),
           concat(out, array(s))))""")
    spans = spans.select("row", merged.alias("spans"))
    found = hits.select("row", "class").distinct().join(named, "class").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.select("row", F.col("id").alias("doc_id"), "content", "n_words").join(spans, "row", "left").join(found, "row", "left")
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return out.select("doc_id", "content", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
                      F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
                      F.col("spans").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    bad = contamination(docs.select("doc_id", "text"), items, window, gram).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("content").alias("_bad_content")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_bad_content"])
    return docs.join(bad, same, "left_anti")


def contamination_sql(window: int = WINDOW) -> str:
    """The same per document as DuckDB SQL, by plain comparison of all windows:
    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = (f"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w")
    return f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {split} FROM documents),
bw AS (SELECT item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {split} FROM benchmark) WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hit AS (SELECT r, i, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
