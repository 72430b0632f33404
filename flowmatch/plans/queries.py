"""Registered queries over the test tables, each with a DuckDB oracle.

Every query reads whole tables; its work grows with them.  ``QUERIES`` maps a
name to ``fn(spark, sf_dir) -> DataFrame`` and ``ORACLES`` the same name to
SQL over the pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowmatch.operators import score as S
from flowmatch.plans import oracle as O
from flowmatch.plans import traces as T
from flowmatch.plans.registry import ORACLES, QUERIES, register  # noqa: F401
from flowmatch.sources.tables import table


# --------------------------------------------------------------------------
# Trace scoring
# --------------------------------------------------------------------------

def _trace_scores(spark: SparkSession, sf_dir: str, method: str = "dice",
                  alternative: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    counts = S.label_counts(T.trace_labels(ev))
    pairs = T.next_week_pairs(ev)
    out = S.score_pairs(pairs, counts, method=method, alternative=alternative, pairs_unique=True)
    return out.drop("m1", "m2")


def _trace_sql(select: str) -> str:
    return ("WITH " + O.trace_pair_stats_sql() +
            f"\nSELECT user_id, week, next_week, {select} FROM st")


@register("q_trace_overall", _trace_sql(O.score_select("dice")))
def q_trace_overall(spark, sf_dir):
    """Flagship: weighted dice of each trace against the user's next active week."""
    return _trace_scores(spark, sf_dir, "dice")


@register("q_trace_alt_score", _trace_sql(O.alt_select("dice")))
def q_trace_alt_score(spark, sf_dir):
    return _trace_scores(spark, sf_dir, "dice", alternative=True)


for _m in ("jaccard", "precision", "recall", "f1"):
    def _mk(m):
        def q(spark, sf_dir):
            return _trace_scores(spark, sf_dir, m)
        q.__name__ = f"q_trace_{m}"
        return q
    register(f"q_trace_{_m}", _trace_sql(O.score_select(_m)))(_mk(_m))


# Further query families register themselves on import.
from flowmatch.plans import q_parse  # noqa: E402,F401
from flowmatch.plans import q_validate  # noqa: E402,F401
from flowmatch.plans import q_match  # noqa: E402,F401
from flowmatch.plans import q_flow  # noqa: E402,F401
from flowmatch.plans import q_diagram  # noqa: E402,F401
