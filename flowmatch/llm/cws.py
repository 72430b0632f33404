"""Document fingerprints by consistent weighted sampling, in SQL functions only.

A text is a set of weighted terms: its words, lower-cased, each with weight
count x length in characters.  For each of ``samples`` seeds and each term of
weight S, draw r and c from Gamma(2, 1) and b from U(0, 1), all from a hash of
term and seed; with t = floor(ln S / r + b) the term's value is

    ln a = ln c - r (t - b + 1)

and the term of least value is the sample.  Two texts draw the same (term, t)
with a probability that equals their generalised Jaccard similarity, the sum of
the lesser weights over the sum of the greater ones.  As ln a depends on term
and t alone, equal least values mean equal samples, so a sample is a minimum of
numbers and an aggregate needs nothing else.

The gamma draws are quantiles on a grid of ``GRID`` points, looked up by bits
of the hash: a logarithm in SQL costs many times a look-up.

``edited`` texts need each row's successor in descending doc_id order.  Rows
are dealt by buckets of doc_id between exact boundaries; inside a bucket the
successor is the next row, and the last row takes the first one of the next
bucket.  No step sorts all rows in one task, and texts are exchanged once.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmatch.llm.common import constant, kept, slots, text_or_empty

SAMPLES = 64
BLOCK = 4             # seeds that one row of a term handles: more make code that Java doesn't compile
GRID = 1 << 12        # gamma quantiles
HEX = 4               # digits of the fingerprint for each sample
EMPTY = 16 ** HEX - 1  # the sample of a text without words
SPACE = r"[\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1


@lru_cache(maxsize=1)
def gamma_quantiles() -> list[float]:
    """Quantiles of Gamma(2, 1) at the mid-points of ``GRID`` equal steps: the
    roots of 1 - (1 + x) exp(-x) = q, by Newton's method."""
    out, x = [], 0.01
    for i in range(GRID):
        q = (i + 0.5) / GRID
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - q) / (x * math.exp(-x))
            x = max(x - step, x / 10)
            if abs(step) < 1e-13:
                break
        out.append(x)
    return out


def _bucket(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below doc_id (null: 0), found in
    two steps over blocks of cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    reached = lambda xs: F.size(F.filter(xs, lambda c: c <= F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))))
    literal = lambda xs: constant(xs, "array<bigint>")
    block = reached(literal(cuts[::step]))
    return F.when(block == 0, 0).otherwise((block - 1) * step + reached(F.slice(literal(cuts), (block - 1) * step + 1, step)))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` with the text of the next row
    in descending doc_id order, the first row being next to the last:
    ``bucket, rn, doc_id, text, next_text, extra``.

    ``(bucket, rn)`` orders and names rows; after the last row of a bucket
    stands an ``extra`` row that repeats the first row of the next bucket.
    Null texts count as empty; null doc_ids come last; rows with equal doc_id
    follow by their text.  Texts pass through one exchange.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # cuts are exact doc_ids; which ones they are changes the layout only
    buckets = buckets or 4 * slots(docs.sparkSession)
    found = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], min(20 * buckets, 200_000))).first()[0] if buckets > 1 else None
    cuts = sorted(set(found or []))
    rows = rows.select(_bucket(cuts).alias("bucket"), "doc_id", F.coalesce(F.bitwise_not("doc_id"), F.lit(_LAST).cast("long")).alias("turn"),
                       F.xxhash64("text").alias("hash"), "text", F.lit(False).alias("extra"))
    # the first row of each bucket, one for each bucket at most
    heads = kept(rows.groupBy("bucket").agg(F.min(F.struct("turn", "hash")).alias("head")).select("bucket", "head.*"))
    down = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.withColumns({"to": F.lag("bucket").over(Window.orderBy(F.desc("bucket"))), "end": F.last("bucket").over(down)})
    after = after.select(F.col("bucket").alias("b"), F.col("turn").alias("t"), F.col("hash").alias("h"), F.coalesce("to", "end").alias("to"))
    same = (F.col("bucket") == F.col("b")) & (F.col("turn") == F.col("t")) & (F.col("hash") == F.col("h"))
    extra = rows.join(F.broadcast(after), same).dropDuplicates(["to"])
    extra = kept(extra.select(F.col("to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "turn", "hash", "text", F.lit(True).alias("extra")))
    order = Window.partitionBy("bucket").orderBy("extra", "turn", "hash", "text")
    return rows.unionByName(extra).select("bucket", F.row_number().over(order).alias("rn"), "doc_id", "text",
                                          F.lead("text").over(order).alias("next_text"), "extra")


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """The text with its last third of code points replaced by as many of the
    first ones of the next text (or all)."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(next_text, F.lit(1), third))


def signatures(texts: DataFrame, keys: list[str], variants: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each text column in ``variants``, the list of its
    samples as numbers of ``HEX`` hexadecimal digits (null for a null text).

    ``keys`` name rows; where their first column has been dealt out by, no
    further exchange happens.  A text without words has ``EMPTY`` throughout.
    """
    tagged = F.array(*[F.struct(F.lit(i).alias("variant"), F.col(c).alias("text")) for i, c in enumerate(variants)])
    rows = texts.select(*keys, F.explode(tagged).alias("v")).where("v.text is not null")
    rows = rows.select(*keys, "v.variant", F.explode(F.split(F.lower("v.text"), SPACE)).alias("word"))
    terms = rows.groupBy(*keys, F.xxhash64("word").alias("term"), F.char_length("word").alias("len")).agg(
        *[F.sum((F.col("variant") == i).cast("int")).alias(f"n{i}") for i in range(len(variants))])
    # an empty word has no weight: its row only stands for the text
    terms = terms.select(*keys, "term", *[F.when(F.col(f"n{i}") > 0, F.when(F.col("len") > 0, F.log(F.col(f"n{i}") * F.col("len")))).alias(f"s{i}") for i in range(len(variants))],
                         *[(F.col(f"n{i}") > 0).alias(f"has{i}") for i in range(len(variants))])
    rows = terms.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(samples // BLOCK - 1))))
    draws, values, least = [], [], []
    grid = gamma_quantiles()
    tables = texts.sparkSession.createDataFrame([(grid, [math.log(x) for x in grid])], "r array<double>, c array<double>")
    r_table, c_table = (tables.select(c).scalar() for c in ("r", "c"))
    for j in range(BLOCK):
        h = F.xxhash64("term", "block", F.lit(j))
        draws += [F.get(r_table, h.bitwiseAND(GRID - 1).cast("int")).alias(f"r{j}"),
                  F.get(c_table, F.shiftrightunsigned(h, 12).bitwiseAND(GRID - 1).cast("int")).alias(f"c{j}"),
                  (F.shiftrightunsigned(h, 24) / float(1 << 40)).alias(f"b{j}")]
        for i in range(len(variants)):
            values.append(F.expr(f"c{j} - r{j} * (floor(s{i} / r{j} + b{j}) - b{j} + 1)").alias(f"a{i}_{j}"))
            least.append(F.min(f"a{i}_{j}").alias(f"a{i}_{j}"))
    has = [f"has{i}" for i in range(len(variants))]
    rows = rows.select(*keys, "block", *has, *[f"s{i}" for i in range(len(variants))], *draws).select(*keys, "block", *has, *values)
    rows = rows.groupBy(*keys, "block").agg(*least, *[F.max(h).alias(h) for h in has])
    sample = lambda c: F.coalesce(F.expr(f"cast(pmod(xxhash64({c}), {EMPTY}) as int)"), F.lit(EMPTY))
    blocks = [F.when(F.col(f"has{i}"), F.array(*[F.when(F.col(f"a{i}_{j}").isNull(), EMPTY).otherwise(sample(f"a{i}_{j}")) for j in range(BLOCK)])).alias(v)
              for i, v in enumerate(variants)]
    rows = rows.select(*keys, F.struct("block", *blocks).alias("blocks")).groupBy(*keys).agg(F.sort_array(F.collect_list("blocks")).alias("blocks"))
    return rows.select(*keys, *[F.when(F.col("blocks")[0][v].isNotNull(), F.flatten(F.col(f"blocks.{v}"))).alias(v) for v in variants])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples, an estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))


def as_hex(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), HEX, "0")), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, samples)`` of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has ``EMPTY`` samples, which are like each other only.
    Repeated rows stay repeated, null ids stay null; an empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = rows.select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"])
    found = signatures(texts.select("key", "text"), ["key"], ["text"], samples).withColumnRenamed("text", "samples")
    return rows.select(F.xxhash64("text").alias("key"), "doc_id").join(found, "key").select("doc_id", "samples")


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For every row its own fingerprint and that of its edited text:
    ``doc_id, n_chars, edited_text_sha256, samples, edited_samples,
    next_samples``, ``next_samples`` being those of the next row's text."""
    rows = with_next(docs)
    # doc_id is a key so that both uses of the rows read the same exchange
    texts = rows.select("bucket", "rn", "doc_id", "text", F.when(~F.col("extra"), edited()).alias("edited"))
    found = signatures(texts, ["bucket", "rn", "doc_id"], ["text", "edited"], samples)
    found = found.withColumn("next", F.lead("text").over(Window.partitionBy("bucket").orderBy("rn")))
    base = rows.where(~F.col("extra")).select("bucket", "rn", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                                              F.sha2(edited(), 256).alias("edited_text_sha256"))
    return base.join(found.drop("doc_id"), ["bucket", "rn"]).select("doc_id", "n_chars", "edited_text_sha256", F.col("text").alias("samples"),
                                                     F.col("edited").alias("edited_samples"), F.col("next").alias("next_samples"))
