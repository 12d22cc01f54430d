"""Risk trend per school: change, direction, chronic and volatile flags, running mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import count_if, round_half_away
from panelwise.functions.windows import by_school, only, top
from panelwise.operators.ranking import consecutive_high


@dataclass(frozen=True)
class TrendModel:
    """Change that counts as a trend, change that counts as volatile, run length."""

    step: float = 0.10
    volatile_step: float = 0.25
    run: int = 3


def with_trend(scored: DataFrame, model: TrendModel = TrendModel()) -> DataFrame:
    """Add the trend columns over each school's full history.

    Rows without a score are looked past, not counted: the previous score is
    that of the last scored row. All windows share the school partitioning.
    """
    past = by_school().rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_school().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored_row = F.col("risk_score").isNotNull()

    def last_scored(col):
        return F.last(F.when(scored_row, F.struct(F.col(col).alias("v"))), ignorenulls=True).over(past)["v"]

    changed = (
        scored.withColumn("prev_risk_score", F.when(scored_row, last_scored("risk_score")))
        .withColumn("risk_delta", F.col("risk_score") - F.col("prev_risk_score"))
        .withColumn("year_over_year_count", F.when(scored_row, F.count("risk_score").over(so_far)).cast("int"))
        .withColumn("cumulative_avg_risk", F.when(scored_row, F.avg("risk_score").over(so_far)))
        .withColumn("chronic_risk_flag", consecutive_high(model.run))
    )
    return changed.withColumns(
        {"trend_direction": direction(model), "volatile_flag": volatile(last_scored("risk_delta"), model)}
    )


def direction(model: TrendModel) -> Column:
    return (
        F.when(F.col("risk_delta").isNull(), "BASELINE")
        .when(F.col("risk_delta") < -model.step, "IMPROVING")
        .when(F.col("risk_delta") > model.step, "DETERIORATING")
        .otherwise("STABLE")
    )


def volatile(last_delta: Column, model: TrendModel) -> Column:
    """1 when this change or the one before is large."""
    swing = F.greatest(F.abs("risk_delta"), F.abs(last_delta))
    return F.coalesce(swing > model.volatile_step, F.lit(False)).cast("int")


def risk_trend(scored: DataFrame, model: TrendModel = TrendModel()) -> DataFrame:
    """The published trend table: scored rows only."""
    return (
        scored.transform(with_trend, model)
        .where(F.col("risk_score").isNotNull())
        .select(
            "school_id",
            "academic_year",
            "risk_score",
            "prev_risk_score",
            "risk_delta",
            "trend_direction",
            "year_over_year_count",
            "chronic_risk_flag",
            "volatile_flag",
            "cumulative_avg_risk",
        )
    )


def _directions() -> list:
    names = ["BASELINE", "IMPROVING", "STABLE", "DETERIORATING"]
    return [count_if(F.col("trend_direction") == n).alias(n.lower()) for n in names]


def trend_summary(trend: DataFrame) -> DataFrame:
    """One row: records per direction, flag totals, mean running average."""
    return trend.agg(
        F.count(F.lit(1)).alias("total"),
        *_directions(),
        F.sum("chronic_risk_flag").alias("chronic"),
        F.sum("volatile_flag").alias("volatile"),
        round_half_away(F.avg("cumulative_avg_risk"), 4).alias("mean_cum_avg"),
    )


def top_deteriorating_districts(trended: DataFrame, k: int = 10) -> DataFrame:
    """Districts by deteriorating school-years. Needs the district column."""
    totals = (
        only(trended, "has_school")
        .where(F.col("risk_score").isNotNull())
        .groupBy("district")
        .agg(
            F.count(F.lit(1)).alias("records"),
            count_if(F.col("trend_direction") == "DETERIORATING").alias("deteriorating"),
            F.sum("chronic_risk_flag").alias("chronic"),
            F.sum("volatile_flag").alias("volatile"),
            round_half_away(F.avg("risk_delta"), 4).alias("avg_delta"),
        )
    )
    return top(totals, k, F.desc("deteriorating"), "district")
