"""One added year: what a school's next row needs from its past, carried from year to year.

The windows over whole histories (growth, averaged growth, runs of high levels,
trend) look back at the last rows and at a running mean. The state holds just that,
one row a school, so a new year is scored from its own rows and the state. The
results are those of the windows over the whole history, to the last bit: the
running sum adds the same numbers in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.functions.windows import by_school, previous
from panelwise.operators import forecast, gaps, ranking, risk, trend
from panelwise.operators.trend import TrendModel

STATE = (
    "school_id string, last_year string, enrolment_1 int, enrolment_2 int, enrolment_3 int, level_1 string, "
    "level_2 string, last_score double, last_delta double, scored_rows int, score_sum double"
)
TREND = [
    "risk_score",
    "prev_risk_score",
    "risk_delta",
    "trend_direction",
    "year_over_year_count",
    "chronic_risk_flag",
    "volatile_flag",
    "cumulative_avg_risk",
]


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def state_of(scored: DataFrame) -> DataFrame:
    """The state after a whole history of scored rows; one exchange by school."""
    so_far = by_school().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored_row = F.col("risk_score").isNotNull()
    rows = (
        trend.with_trend(scored)
        .withColumns(
            {
                "enrolment_2": previous("total_enrolment", 1),
                "enrolment_3": previous("total_enrolment", 2),
                "level_2": previous("risk_level", 1),
                "last_score": F.last("risk_score", ignorenulls=True).over(so_far),
                "_delta": F.last(F.when(scored_row, F.struct("risk_delta")), ignorenulls=True).over(so_far),
                "scored_rows": F.count("risk_score").over(so_far).cast("int"),
                "score_sum": F.coalesce(F.sum("risk_score").over(so_far), F.lit(0.0)),
                "_next": F.lead("academic_year").over(by_school()),
            }
        )
        .where(F.col("_next").isNull())
    )
    return rows.select(
        "school_id",
        F.col("academic_year").alias("last_year"),
        F.col("total_enrolment").alias("enrolment_1"),
        "enrolment_2",
        "enrolment_3",
        F.col("risk_level").alias("level_1"),
        "level_2",
        "last_score",
        F.col("_delta.risk_delta").alias("last_delta"),
        "scored_rows",
        "score_sum",
    )


def merge(state: DataFrame, facts: DataFrame, model: TrendModel = TrendModel()) -> DataFrame:
    """Rows of one year next to the state of their schools, scored; schools without a row keep their state.

    Read `year_rows` and `next_state` from it once it is published. A row whose
    year does not come after its school's last one ends the job.
    """
    if model.run != 3:
        raise ValueError("the state holds two levels, enough for runs of three rows")
    past = state.select("school_id", *[F.col(c).alias(f"_{c}") for c in state.columns if c != "school_id"])
    rows = facts.transform(gaps.with_gaps).transform(risk.with_deficit_ratios).withColumn("_new", F.lit(True))
    both = rows.join(past, "school_id", "full_outer")
    late = F.col("academic_year") <= F.col("_last_year")
    message = F.concat(F.lit("years must be added in order: "), F.col("academic_year"))
    year = F.when(late, F.raise_error(message)).otherwise(F.col("academic_year"))
    scored_row = F.col("risk_score").isNotNull()
    levels = [F.col("total_enrolment"), *[F.col(f"_enrolment_{i}") for i in (1, 2, 3)]]
    return (
        both.withColumn("academic_year", year.cast("string"))
        .withColumn("enrolment_growth_rate", risk.growth_since(F.col("_enrolment_1")))
        .transform(risk.with_score)
        .withColumns(
            {
                "prev_risk_score": F.when(scored_row, F.col("_last_score")),
                "year_over_year_count": F.when(scored_row, F.coalesce("_scored_rows", F.lit(0)) + 1).cast("int"),
                "_sum": F.coalesce("_score_sum", F.lit(0.0)) + F.col("risk_score"),
                "avg_growth_rate": forecast.average_growth(forecast.change_of(levels), levels[1]),
                "chronic_risk_flag": ranking.all_high([F.col(c) for c in ("risk_level", "_level_1", "_level_2")]),
            }
        )
        .withColumn("risk_delta", F.col("risk_score") - F.col("prev_risk_score"))
        .withColumns(
            {
                "cumulative_avg_risk": F.when(scored_row, F.col("_sum") / F.col("year_over_year_count")),
                "trend_direction": trend.direction(model),
                "volatile_flag": trend.volatile(F.col("_last_delta"), model),
            }
        )
    )


def year_rows(merged: DataFrame) -> DataFrame:
    """The added year with its risk, trend and averaged growth."""
    return merged.where(F.col("_new")).drop(*[c for c in merged.columns if c.startswith("_")])


def next_state(merged: DataFrame) -> DataFrame:
    new, scored_row = F.coalesce("_new", F.lit(False)), F.coalesce(F.col("_new") & F.col("risk_score").isNotNull(), F.lit(False))

    def moved(value: str, old: str, when=new) -> Column:
        return F.when(when, F.col(value)).otherwise(F.col(old))

    return merged.select(
        "school_id",
        moved("academic_year", "_last_year").alias("last_year"),
        moved("total_enrolment", "_enrolment_1").alias("enrolment_1"),
        moved("_enrolment_1", "_enrolment_2").alias("enrolment_2"),
        moved("_enrolment_2", "_enrolment_3").alias("enrolment_3"),
        moved("risk_level", "_level_1").alias("level_1"),
        moved("_level_1", "_level_2").alias("level_2"),
        moved("risk_score", "_last_score", scored_row).alias("last_score"),
        moved("risk_delta", "_last_delta", scored_row).alias("last_delta"),
        F.coalesce(moved("year_over_year_count", "_scored_rows", scored_row), F.lit(0)).alias("scored_rows"),
        F.coalesce(moved("_sum", "_score_sum", scored_row), F.lit(0.0)).alias("score_sum"),
    )
