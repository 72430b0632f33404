"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked good; unlabelled web text is a sample
of all documents whatever their mark, which is never read for them.  With a
class prior p the risk of a scorer f is written without negatives,

    p E_pos[l(f)] + E_unl[l(-f)] - p E_pos[l(-f)],

and the part in the last two terms, the risk on negatives, cannot be below
zero: where the sample's estimate falls below it, the step goes the other way
(the non-negative unbiased estimate).  The scorer is linear in fixed measures
of a text's bytes, words and lines, so scoring is one pass over the texts.

The class prior is estimated from the same two samples, without negatives.
Whatever a scorer, the unlabelled texts above a threshold hold at least the
positives among them, so their share is at least the prior times the share of
trusted positives there: the least ratio of the two shares over all thresholds
bounds the prior from above, and is near it if some threshold leaves out most
negatives.  A scorer fitted on one half of the samples is read on the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import ship_code, text_or_empty

FOLDS = 5            # crc32(doc_id) mod FOLDS = 0 is held out
THRESHOLD = 0.3      # scores from here on are predicted good
POSITIVES = 8_000    # most trusted positives that the fit uses
UNLABELLED = 16_000  # most unlabelled texts that the fit uses
STEPS, RATE, DECAY = 200, 0.05, 1e-3
ROUNDS = 4           # fits that the prior is estimated by, each with the estimate before

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(_PUNCTUATION) + 13


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes, and how words and lines vary and repeat."""
    out = np.zeros(N_FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    parts = data.split()
    if not parts:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(parts)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    lengths = np.fromiter(map(len, parts), np.int64, w)
    lines = data.split(b"\n")
    repeats = sum(map(bytes.__eq__, parts, parts[1:]))
    k = len(_PUNCTUATION)
    out[:k] = np.sqrt(counts[_PUNCTUATION] / n)
    out[k:] = (upper / n, lower / n, counts[48:58].sum() / n, counts[128:].sum() / n, counts[9:14].sum() / n,
               upper / (upper + lower + 1), np.log1p(lengths.mean()), lengths.std() / lengths.mean(),
               np.sqrt(repeats / w), len(set(parts)) / w ** 0.8, 1 - len(set(lines)) / len(lines), np.log1p(w) / 10,
               counts[_PUNCTUATION].sum() / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        f = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Least non-negative risk with the sigmoid loss, by Adam on all rows."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.c_[x, np.ones(len(x))] for x in (p, u))
    theta = np.zeros(p.shape[1])
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))) for x in (p, u))
        gp, gu = (x.T @ (s * (1 - s)) / len(x) for x, s in ((p, sp), (u, su)))
        # sigmoid loss: l(f) = 1 - s, l(-f) = s
        negative_risk = su.mean() - prior * sp.mean()
        gradient = -prior * gp + (gu - prior * gp) if negative_risk >= 0 else -(gu - prior * gp)
        gradient[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the class prior from scores of both samples.  Each share
    is allowed its sampling error, so thresholds that few texts reach, whose
    ratio is left to chance, don't set the bound."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    error = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled: the mean of both ways to fit on
    one half and read the other, repeated with what the last round gave."""
    prior = 0.5
    for _ in range(ROUNDS):
        found = []
        for half in (0, 1):
            model = fit(positive[half::2], unlabelled[half::2], prior) if len(positive) > 1 and len(unlabelled) > 1 else fit(positive, unlabelled, prior)
            found.append(least_ratio(model.score(positive[1 - half::2]), model.score(unlabelled[1 - half::2])))
        prior = float(np.mean(found))
    return prior


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of a document are kept from the fit."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on the documents whose labels aren't held out.

    ``labels(doc_id, quality, ...)``; a document is a trusted positive if all
    its labels are 1; other labels are not read.  The class prior is estimated
    from the two samples.  Both are the ids of least hash, ``positives`` and
    ``unlabelled`` at most, so they are the same however the tables are stored;
    of an id with several texts one is taken by the order of its measures.
    Without trusted positives or texts every score is one half.
    """
    ship_code(docs.sparkSession)
    marked = labels.where("doc_id is not null and quality is not null").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = docs.where("doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"))

    def least(df, n, positive):
        chosen = df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        return chosen.distinct().select(F.col("doc_id").alias("_id"), F.lit(positive).alias("_positive"))

    # at most positives + unlabelled ids: a broadcast of known size
    chosen = least(marked.where("quality = 1"), positives, True).unionByName(least(ids, unlabelled, False))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for b in batches:
            measured = [features(t).astype("<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(measured, pa.binary())], ["_id", "_positive", "_x"])

    rows = rows.mapInArrow(run, "_id long, _positive boolean, _x binary").groupBy("_id", "_positive").agg(F.min("_x").alias("_x"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_positive").toPandas()
    x = np.frombuffer(b"".join(rows["_x"]), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    positive = rows["_positive"].to_numpy(bool)
    if not positive.any() or positive.all():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    return fit(x[positive], x[~positive], estimate_prior(x[positive], x[~positive]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row: how likely it is good, from its text alone.

    A null text counts as empty; an empty one is scored like any other.
    Repeated rows stay repeated, a null doc_id stays null.
    """
    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(model.score(x) >= threshold))

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
