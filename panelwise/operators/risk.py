"""Composite risk: deficit ratios, enrolment growth, score, level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import count_if, exact_mean, ratio, round_half_away, sql_least
from panelwise.functions.windows import only, previous, top

LEVELS = ["CRITICAL", "HIGH", "MODERATE", "LOW"]
HIGH_LEVELS = ["HIGH", "CRITICAL"]


@dataclass(frozen=True)
class RiskModel:
    """Weights, growth cap and level bounds (fixed values by default)."""

    teacher_weight: float = 0.45
    classroom_weight: float = 0.35
    growth_weight: float = 0.20
    growth_cap: float = 0.50
    digits: int = 4
    bounds: tuple = field(default=(("CRITICAL", 0.75), ("HIGH", 0.50), ("MODERATE", 0.20)))
    lowest: str = "LOW"

    @property
    def distinct_scores(self) -> int:
        """Proven bound on distinct rounded scores: ratios are at most 1, growth is capped."""
        top_score = self.teacher_weight + self.classroom_weight + self.growth_weight * self.growth_cap
        return int(top_score * 10**self.digits) + 2


def with_deficit_ratios(gapped: DataFrame) -> DataFrame:
    """Gap over requirement, at most 1; NULL without a requirement or a teacher record."""

    def share(gap: str, required: str) -> Column:
        return sql_least(ratio(F.coalesce(gap, F.lit(0)), required), F.lit(1.0))

    rooms, teachers = share("classroom_gap", "required_class_rooms"), share("teacher_gap", "required_teachers")
    if "has_teachers" in gapped.columns:
        rooms, teachers = F.when(F.col("has_teachers"), rooms), F.when(F.col("has_teachers"), teachers)
    return gapped.withColumn("classroom_deficit_ratio", rooms).withColumn("teacher_deficit_ratio", teachers)


def growth_since(before) -> Column:
    """Growth of enrolment since the value of the row before; 0 without one and after a 0."""
    return F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise(ratio(F.col("total_enrolment") - before, before))


def with_growth(df: DataFrame, calendar_adjacent: bool = False) -> DataFrame:
    """Year-over-year enrolment growth; 0 for the first row and after a 0.

    The lag runs over the whole panel; filter years afterwards.
    """
    prev = previous("total_enrolment", 1, calendar_adjacent)
    return df.withColumn("_prev", prev).withColumn("enrolment_growth_rate", growth_since(F.col("_prev"))).drop("_prev")


def risk_level(raw, model: RiskModel) -> Column:
    expr = None
    for level, bound in model.bounds:
        cond = raw > F.lit(bound)
        expr = F.when(cond, level) if expr is None else expr.when(cond, level)
    return expr.otherwise(model.lowest)


def with_score(df: DataFrame, model: RiskModel = RiskModel()) -> DataFrame:
    """Weighted score rounded for storage; the level is taken from the unrounded value."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    raw = (
        F.lit(model.teacher_weight) * known("teacher_deficit_ratio")
        + F.lit(model.classroom_weight) * known("classroom_deficit_ratio")
        + F.lit(model.growth_weight)
        * F.least(F.abs(known("enrolment_growth_rate")), F.lit(model.growth_cap))
    )
    return (
        df.withColumn("_raw", raw)
        .withColumn("risk_score", round_half_away("_raw", model.digits))
        .withColumn("risk_level", risk_level(F.col("_raw"), model))
        .drop("_raw")
    )


def with_risk(gapped: DataFrame, model: RiskModel = RiskModel(), calendar_adjacent: bool = False) -> DataFrame:
    return (
        gapped.transform(with_deficit_ratios)
        .transform(with_growth, calendar_adjacent)
        .transform(with_score, model)
    )


def level_counts(suffix: str = "") -> list[Column]:
    return [count_if(F.col("risk_level") == v).alias(v.lower() + suffix) for v in LEVELS]


def risk_summary(scored: DataFrame) -> DataFrame:
    """One row: records, mean score, records per level."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_records"),
        round_half_away(exact_mean("risk_score"), 4).alias("avg_risk"),
        *level_counts("_count"),
    )


def top_risk_districts(scored: DataFrame, k: int = 10) -> DataFrame:
    """Districts by mean score over all school-years, with their critical count."""
    means = (
        only(scored, "has_school")
        .where(F.col("risk_score").isNotNull())
        .groupBy("district")
        .agg(
            round_half_away(exact_mean("risk_score"), 4).alias("avg_risk"),
            count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
            F.count(F.lit(1)).alias("school_years"),
        )
    )
    return top(means, k, F.desc("avg_risk"), "district")
