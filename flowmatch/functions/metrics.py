"""Column expressions for list similarity (L1-L6) and weighted means (M4).

Every metric is computed from three integers per (pair, category):
``n1`` (size of the truth list), ``n2`` (size of the candidate list) and
``i`` (size of the multiset intersection after matching).  The formulas keep
the operand order of the scoring definition so that doubles agree bit for
bit with a SQL oracle that writes them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("dice", "jaccard", "precision", "recall", "f1")


def _d(c: Column) -> Column:
    return c.cast("double")


def dice(n1: Column, n2: Column, i: Column) -> Column:
    """2*I/(n1+n2); score 1 when both lists are empty."""
    return F.when((n1 + n2) == 0, F.lit(1.0)).otherwise(_d(2 * i) / _d(n1 + n2))


def jaccard(n1: Column, n2: Column, i: Column) -> Column:
    """I/(n1+n2-I); score 1 when both lists are empty."""
    u = n1 + n2 - i
    return F.when(u == 0, F.lit(1.0)).otherwise(_d(i) / _d(u))


def precision(n1: Column, n2: Column, i: Column) -> Column:
    """I/n2 (the first list is the truth); 0 for an empty candidate."""
    return F.when(n2 == 0, F.lit(0.0)).otherwise(_d(i) / _d(n2))


def recall(n1: Column, n2: Column, i: Column) -> Column:
    """I/n1; 0 for an empty truth list."""
    return F.when(n1 == 0, F.lit(0.0)).otherwise(_d(i) / _d(n1))


def f1(n1: Column, n2: Column, i: Column) -> Column:
    p, r = precision(n1, n2, i), recall(n1, n2, i)
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * (p * r) / (p + r))


def harmonic_weight(n1: Column, n2: Column) -> Column:
    """2*n1*n2/(n1+n2); 0 if either list is empty, so a category missing on
    one side is not penalised."""
    return F.when((n1 + n2) == 0, F.lit(0.0)).otherwise(_d(2 * n1 * n2) / _d(n1 + n2))


def metric(method: str, n1: Column, n2: Column, i: Column) -> Column:
    """Score expression for ``method``; unknown methods fail at plan time."""
    fns = {"dice": dice, "jaccard": jaccard, "precision": precision,
           "recall": recall, "f1": f1}
    if method not in fns:
        raise ValueError(f"unknown similarity method {method!r}; use one of {METHODS}")
    return fns[method](n1, n2, i)


def weighted_mean(pairs: list[tuple[Column, Column]]) -> Column:
    """sum(score*weight)/sum(weight), summed left to right; 0 if the weights sum to 0."""
    num = None
    den = None
    for s, w in pairs:
        num = s * w if num is None else num + s * w
        den = w if den is None else den + w
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


# ---- SQL twins of the expressions above (used to write DuckDB oracles) ----

def sql_metric(method: str, n1: str, n2: str, i: str) -> str:
    d = "CAST({} AS DOUBLE)".format
    if method == "dice":
        return f"CASE WHEN ({n1} + {n2}) = 0 THEN 1.0 ELSE {d(f'2 * {i}')} / {d(f'{n1} + {n2}')} END"
    if method == "jaccard":
        return (f"CASE WHEN ({n1} + {n2} - {i}) = 0 THEN 1.0 "
                f"ELSE {d(i)} / {d(f'{n1} + {n2} - {i}')} END")
    if method == "precision":
        return f"CASE WHEN {n2} = 0 THEN 0.0 ELSE {d(i)} / {d(n2)} END"
    if method == "recall":
        return f"CASE WHEN {n1} = 0 THEN 0.0 ELSE {d(i)} / {d(n1)} END"
    if method == "f1":
        p = sql_metric("precision", n1, n2, i)
        r = sql_metric("recall", n1, n2, i)
        return f"CASE WHEN (({p}) + ({r})) = 0 THEN 0.0 ELSE 2 * (({p}) * ({r})) / (({p}) + ({r})) END"
    raise ValueError(method)


def sql_weight(n1: str, n2: str) -> str:
    return (f"CASE WHEN ({n1} + {n2}) = 0 THEN 0.0 "
            f"ELSE CAST(2 * {n1} * {n2} AS DOUBLE) / CAST({n1} + {n2} AS DOUBLE) END")


def sql_weighted_mean(pairs: list[tuple[str, str]]) -> str:
    num = " + ".join(f"({s}) * ({w})" for s, w in pairs)
    den = " + ".join(f"({w})" for _, w in pairs)
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / ({den}) END"
