"""The report: one wide row per school-year with every derived column.

This is what the dashboards read. It is computed from the facts once and
published partitioned by academic year, so a view touches one partition and
the few columns it shows instead of joining six tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import allocation, gaps, ranking, risk, trend


def scored(facts: DataFrame) -> DataFrame:
    """Facts with gaps and risk."""
    return facts.transform(gaps.with_gaps).transform(risk.with_risk)


def _keeping_rest(df: DataFrame, flag: str, step) -> DataFrame:
    """Apply a step to rows that have the flag and keep the others with NULLs."""
    if flag not in df.columns:
        return step(df)
    return step(df.where(F.col(flag))).unionByName(df.where(~F.col(flag)), allowMissingColumns=True)


def report(facts: DataFrame, stage=lambda name, df: df) -> DataFrame:
    """Facts with gaps, risk, flags, trend, ranks and allocation.

    Ranking and allocation read their input more than once. `stage` may publish
    the flagged and the ranked rows at those points and hand back the published
    table; by default everything stays one lazy plan.
    """
    flags = scored(facts).transform(ranking.with_persistent_flag).transform(trend.with_trend)
    flagged = stage("flagged", flags)
    ranked = stage("ranked", _keeping_rest(flagged, "has_school", ranking.with_ranks))
    return _keeping_rest(ranked, "has_teachers", allocation.with_allocation)
