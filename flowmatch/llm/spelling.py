"""Spelling variants: words one inserted, deleted or replaced letter apart, by
pairs of trie nodes.

A word of L letters runs through L + 1 nodes of the trie of all words and
L + 1 nodes of the trie of all reversed words.  It is the pair (node of its
first i letters, node of what follows) for every i; with its letter i skipped
it is the pair (node of the letters before i, node of the letters after i).
Two words that share a skipped pair differ in that one letter; a word's
skipped pair that is another word's whole pair is that word with one letter
inserted.  So one grouping by integer pairs finds all neighbours, and nothing
else: a group holds at most one word for each letter and one whole word.

Nodes are numbered by rule, a child from its parent's number and its letter,
so that every task numbers the same node alike and no trie is gathered.  Two
nodes that happen to share a 64-bit number can only add a pair, which the
comparison of the two words removes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, ship_code, text_or_empty

MIN_LETTERS = 7
MIN_COUNT = 2
THINNED = 31          # one in so many (document, run) pairs loses a letter
COMMONER = 10         # a form is at least so many times as frequent
HELD = 200_000        # words that a task counts before it hands them on
ENTRIES = 1 << 16     # trie pairs handed to Spark at a time

_MASK = (1 << 64) - 1


def _runs(text: str, min_letters: int) -> list[str]:
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    return re.findall("[a-zÀ-ÿ]{%d,}" % min_letters, low)


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, thinned: int = THINNED) -> DataFrame:
    """``(word, n)`` of all words of at least ``min_letters`` letters in
    ``docs(doc_id, text, ...)``: maximal runs of letters, A-Z lower-cased.
    Where ``thinned`` divides the CRC-32 h of ``<doc_id>:<run>``, the run's
    letter h % length is left out (a null doc_id is the empty text there)."""
    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                head = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(_runs(text, min_letters)).items():
                    h = crc32(word.encode(), head)
                    if h % thinned == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_letters:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _nodes(letters) -> list[int]:
    """Numbers of the trie nodes on a path from the root, as signed longs."""
    number, out = 0, [0]
    for c in letters:
        number = ((number ^ ord(c)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
        number ^= number >> 32
        out.append(number - (1 << 64) if number >> 63 else number)
    return out


def node_pairs(words: DataFrame) -> DataFrame:
    """``(prefix, suffix, word_id, skipped)`` of ``words(word_id, word)``: each
    word's node pairs, whole and with one letter skipped."""
    names = ["prefix", "suffix", "word_id", "skipped"]

    def run(batches):
        out: list[list] = [[], [], [], []]
        for b in batches:
            for word_id, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ahead, behind = _nodes(word), _nodes(reversed(word))[::-1]
                for skipped in (False, True):
                    n = len(word) + (not skipped)
                    for at in range(0, n, ENTRIES):
                        to = min(n, at + ENTRIES)
                        out[0] += ahead[at:to]
                        out[1] += behind[at + skipped:to + skipped]
                        out[2] += [word_id] * (to - at)
                        out[3] += [skipped] * (to - at)
                        if len(out[0]) >= ENTRIES:
                            yield batch(out)
                            out = [[], [], [], []]
        if out[0]:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.bool_())], names)

    ship_code(words.sparkSession)
    return words.select("word_id", "word").mapInArrow(run, "prefix long, suffix long, word_id long, skipped boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """``(a, b)``, both ways, of all word_ids in ``words(word_id, word, ...)``
    (distinct words) that are exactly one inserted, deleted or replaced letter apart."""
    groups = node_pairs(words).groupBy("prefix", "suffix").agg(
        F.collect_list(F.when(F.col("skipped"), F.col("word_id"))).alias("skip"),
        F.collect_list(F.when(~F.col("skipped"), F.col("word_id"))).alias("whole"))
    groups = groups.where("size(skip) > 0 and size(skip) + size(whole) > 1")
    pairs = groups.select(F.explode("skip").alias("a"), "skip", "whole").select("a", F.explode(F.concat("skip", "whole")).alias("b")).where("a <> b")
    # a letter that stands several times in a row is skipped at several places
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    word = words.select("word_id", "word")
    pairs = pairs.join(word.toDF("a", "word_a"), "a").join(word.toDF("b", "word_b"), "b")
    pairs = pairs.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")


def _roots(forms: DataFrame, top: int) -> DataFrame:
    """``(word_id, root_id)`` of ``forms(word_id, form_id)``: where the forms lead.
    A form is ``COMMONER`` times as frequent, so a path has at most log(top) steps."""
    steps = max(1, math.floor(math.log(max(2, top), COMMONER)) + 1)
    ends = kept(forms.select("word_id", F.col("form_id").alias("root_id")))
    for _ in range(math.ceil(math.log2(steps))):
        further = ends.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        ends = kept(ends.join(further, "root_id", "left").select("word_id", F.coalesce("next", "root_id").alias("root_id")))
    return ends


def variant_groups(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, thinned: int = THINNED) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word with at least
    ``min_count`` occurrences (see ``word_counts``).

    ``n_near`` counts the words one letter away.  ``form`` is the most frequent
    of them (ties: the smallest in code-point order) if it is at least
    ``COMMONER`` times as frequent as the word, else null, ``form_n`` its
    count; ``root`` is the word that following the forms ends at.  Null and
    empty texts have no words, repeated rows count repeatedly, other columns
    are left out; an empty table gives an empty result.
    """
    counts = word_counts(docs, min_letters, thinned).where(F.col("n") >= min_count)
    words = kept(counts.withColumn("word_id", F.monotonically_increasing_id()))
    near = neighbours(words).join(words.select(F.col("word_id").alias("b"), (-F.col("n")).alias("minus"), F.col("word").alias("form")), "b")
    best = near.groupBy(F.col("a").alias("word_id")).agg(F.count("*").alias("n_near"), F.min(F.struct("minus", "form", "b")).alias("best"))
    found = words.join(best, "word_id", "left")
    is_form = -F.col("best.minus") >= COMMONER * F.col("n")
    found = kept(found.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              *[F.when(is_form, c).alias(a) for c, a in ((F.col("best.form"), "form"), (-F.col("best.minus"), "form_n"), (F.col("best.b"), "form_id"))]))
    top = found.agg(F.max("n")).first()[0] or 1
    ends = _roots(found.where("form_id is not null").select("word_id", "form_id"), top)
    ends = ends.join(words.select(F.col("word_id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return found.join(ends, "word_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
