"""District compliance index: roll-up, grade, yearly change and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, count_if, exact_mean, pct, round_half_away, schools
from panelwise.functions.windows import in_latest_of_few, only, top
from panelwise.operators.risk import HIGH_LEVELS

# Grade and the largest mean risk it takes.
GRADES = (("A", 0.15), ("B", 0.30), ("C", 0.50), ("D", 0.75))
LOWEST_GRADE = "F"


def grade(mean_risk):
    mean_risk = as_col(mean_risk)
    expr = None
    for name, bound in GRADES:
        cond = mean_risk <= bound
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(LOWEST_GRADE)


def district_rollup(scored: DataFrame, keyed: bool = False) -> DataFrame:
    """One row per district and year. The grade comes from the unrounded mean.

    `keyed` says that school and year are known to be a key (`store.is_key`).
    Partial aggregation then reduces every input partition to districts x years
    rows before the shuffle, so a district that holds most schools costs
    nothing extra; otherwise schools are counted as distinct values, row by row.
    """
    rows = only(scored, "has_school").where(F.col("risk_score").isNotNull())
    return (
        rows.withColumn("district", F.coalesce("district", F.lit("UNKNOWN")))
        .groupBy("district", "academic_year")
        .agg(
            schools(keyed).alias("total_schools"),
            exact_mean("risk_score").alias("_mean"),
            pct(count_if(F.col("risk_level").isin(HIGH_LEVELS)), F.count(F.lit(1)), 2).alias("pct_high_critical"),
            F.sum(F.when(F.col("classroom_gap") > 0, F.col("classroom_gap")).otherwise(0)).alias(
                "total_classroom_deficit"
            ),
            F.sum(F.when(F.col("teacher_gap") > 0, F.col("teacher_gap")).otherwise(0)).alias(
                "total_teacher_deficit"
            ),
            F.sum("total_enrolment").alias("total_enrolment"),
            round_half_away(exact_mean("classroom_condition_score", 0), 4).alias("avg_classroom_condition"),
        )
        .withColumn("avg_risk_score", round_half_away("_mean", 4))
        .withColumn("compliance_grade", grade("_mean"))
        .drop("_mean")
    )


def with_change_and_rank(rollup: DataFrame) -> DataFrame:
    """Change of the rounded mean against the district's previous year, and rank 1 = worst per year.

    Both windows run over districts x years rows only.
    """
    history = Window.partitionBy("district").orderBy("academic_year")
    year = Window.partitionBy("academic_year").orderBy(F.desc("avg_risk_score"))
    change = F.col("avg_risk_score") - F.lag("avg_risk_score").over(history)
    return rollup.withColumn("yoy_risk_improvement", change).withColumn("district_rank", F.rank().over(year))


def district_index(scored: DataFrame, keyed: bool = False) -> DataFrame:
    """The published index table."""
    return (
        scored.transform(district_rollup, keyed)
        .transform(with_change_and_rank)
        .select(
            "district",
            "academic_year",
            "total_schools",
            "avg_risk_score",
            "pct_high_critical",
            "total_classroom_deficit",
            "total_teacher_deficit",
            "total_enrolment",
            "avg_classroom_condition",
            "yoy_risk_improvement",
            "district_rank",
            "compliance_grade",
        )
    )


def index_summary(index: DataFrame) -> DataFrame:
    """One row over the index, with grade counts."""
    grades = [name for name, _ in GRADES] + [LOWEST_GRADE]
    return index.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("district").alias("total_districts"),
        round_half_away(exact_mean("avg_risk_score"), 4).alias("overall_avg_risk"),
        round_half_away(exact_mean("pct_high_critical", 2), 2).alias("avg_pct_high_critical"),
        F.sum("total_classroom_deficit").alias("grand_classroom_deficit"),
        F.sum("total_teacher_deficit").alias("grand_teacher_deficit"),
        *[count_if(F.col("compliance_grade") == g).alias(f"grade_{g.lower()}") for g in grades],
    )


def riskiest_districts(index: DataFrame, k: int = 10, year: str | None = None) -> DataFrame:
    """Districts of one year (the latest by default) by mean risk."""
    return top(
        in_latest_of_few(index, year).select(
            "district",
            "academic_year",
            "avg_risk_score",
            "pct_high_critical",
            "total_classroom_deficit",
            "total_teacher_deficit",
            "district_rank",
            "compliance_grade",
        ),
        k,
        F.desc("avg_risk_score"),
        "district",
    )
