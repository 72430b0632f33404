"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The best segmentation of a word under a unigram model comes from forward
scores: the best score of each prefix.  Words that share a prefix share its
scores, so a batch's distinct pre-tokens are put in a trie, and each node's
score is computed once, from its ancestors; a terminal node stores the number
of tokens of the best segmentation.  Walking the words in sorted order visits
the trie depth first, so one path of scores is all that is kept.

The vocabulary is a public file of byte-level ranks.  Its scores are the log
probabilities of Zipf's law by rank, ``-log(rank + OFFSET)``: a fixed model
that needs no training.  Of equal scores the one with fewer tokens wins.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import ship_code, text_or_empty
from flowmatch.llm.pretoken import cut, pieces

OFFSET = 2.7          # Zipf-Mandelbrot shift
CACHED = 400_000      # pre-tokens whose counts a worker remembers


class Unigram:
    """Scores and token counts for one vocabulary, kept by a Python worker."""

    _own: dict[str, "Unigram"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.score = {t: -math.log(r + OFFSET) for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.known: dict[bytes, tuple[int, float]] = {}

    @classmethod
    def of(cls, path: str) -> "Unigram":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def terminals(self, words: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """Token count and forward score at each word's terminal node.

        ``path[i]`` holds the (score, -tokens) of the current word's prefix of
        i bytes; of the next word in order only the bytes after the common
        prefix, its new trie nodes, are computed.
        """
        score, longest, out = self.score.get, self.longest, {}
        path: list[tuple[float, int]] = [(0.0, 0)]
        last = b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best = (-math.inf, 0)
                for begin in range(max(0, end - longest), end):
                    s = score(word[begin:end])
                    if s is not None:
                        before = path[begin]
                        if (found := (before[0] + s, before[1] - 1)) > best:
                            best = found
                path.append(best)
            out[word] = (-path[-1][1], path[-1][0])
            last = word
        return out

    def counts(self, texts: list[str]):
        """Per text: pre-tokens, tokens, score."""
        for part in pieces(texts):
            distinct, index, each = cut(part)
            new = [w for w in distinct if w not in self.known]
            if len(self.known) + len(new) > CACHED:
                self.known.clear()
                new = distinct
            self.known.update(self.terminals(new))
            found = np.array([self.known[w] for w in distinct], np.float64).reshape(-1, 2)[index]
            ends = np.cumsum(each)
            total = np.zeros((len(found) + 1, 2))
            np.cumsum(found, axis=0, out=total[1:])
            yield each, (total[ends] - total[ends - each])


def token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, score)`` of every row of ``docs``:
    tokens of the best unigram segmentation, and its log probability.

    A null or empty text has none and score 0.  Repeated rows stay repeated,
    null ids stay null, other columns are left out; an empty table stays empty.
    """
    def run(batches):
        for b in batches:
            found = list(Unigram.of(ranks_path).counts(b.column(1).to_pylist()))
            each = np.concatenate([e for e, _ in found]) if found else np.zeros(0, np.int64)
            sums = np.concatenate([s for _, s in found]) if found else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(each.astype(np.int64)), pa.array(np.rint(sums[:, 0]).astype(np.int64)), pa.array(np.round(sums[:, 1], 4) + 0.0)],
                ["doc_id", "n_pretokens", "n_tokens", "score"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
