"""Outcome codes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pybool(c: Column) -> Column:
    """Render a boolean the way the summaries print it: True / False / None."""
    return F.when(c.isNull(), "None").when(c, "True").otherwise("False")


def outcome_code(mapping: Column, status: Column, epap: Column, exact: Column) -> Column:
    """A1: ``False`` (not mapped), ``True,False`` (mapped, unusable meaning) or
    ``True,True,<epap>,<similarity == 1>``."""
    return (F.when(mapping == F.lit(False), F.lit("False"))
            .when(status == F.lit(False), F.concat(_pybool(mapping), F.lit(","), _pybool(status)))
            .otherwise(F.concat_ws(",", _pybool(mapping), _pybool(status), _pybool(epap), _pybool(exact))))


def outcome_counts(comp: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """A2/A4: (keys..., outcome, n) for all groups in one aggregate."""
    return comp.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("n"))


def success_counts(scores: DataFrame, keys: list[str], exact: str = "is_exact") -> DataFrame:
    """A3: per group the number of scores equal to 1 (``True``) and not (``False``)."""
    return (scores.groupBy(*keys, _pybool(F.col(exact)).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


def provider_average(counts: DataFrame, provider: str, keys: list[str], digits: int = 6,
                     providers: list[str] | None = None) -> DataFrame:
    """A5: mean count of each outcome over all providers (a provider without
    the outcome counts 0).  ``providers`` names those that count although they
    may have no row; by default the ones in ``counts``."""
    s = counts.groupBy(*keys, "outcome").agg(F.sum("n").alias("_s"))
    k = F.lit(float(len(set(providers)))) if providers is not None else \
        counts.agg(F.count_distinct(provider).cast("double")).scalar()
    return s.select(*keys, "outcome", F.round(F.col("_s") / k, digits).alias("avg_n"))


def approach_compare(comp: DataFrame, keys: list[str], approach: str, success: Column,
                     approaches: list[str]) -> DataFrame:
    """Successes per approach side by side, with subtotals and a grand
    total from ``rollup``.  ``total_level`` tells a total from a NULL key: 0 for
    a group, else the bits of the keys that are summed over, the last key's
    being 1."""
    c = comp.withColumn("_ok", success.cast("int"))
    agg = [F.sum(F.when(F.col(approach) == a, F.col("_ok")).otherwise(0)).cast("long").alias(f"{a}_success")
           for a in approaches]
    agg += [F.sum(F.when(F.col(approach) == a, 1).otherwise(0)).cast("long").alias(f"{a}_n")
            for a in approaches]
    return c.rollup(*keys).agg(F.grouping_id(*keys).cast("int").alias("total_level"), *agg)
