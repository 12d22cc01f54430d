"""Enrolment forecast from a weighted moving average of yearly changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, clamp, ratio, round_half_away, shifted_year
from panelwise.functions.norms import DEFAULT_CATEGORY, norm
from panelwise.functions.windows import in_year, only, previous, top
from panelwise.operators.gaps import norm_requirement, shortfall

# Weights of the last three changes, growth bound, horizons.
WEIGHTS = (3, 2, 1)
GROWTH_CAP = 0.30
HORIZONS = (1, 2, 3)


def weighted_change(enrolment: str = "total_enrolment") -> Column:
    """3, 2, 1 times the last three yearly changes; a missing change counts as 0."""
    return change_of([F.col(enrolment)] + [previous(enrolment, i) for i in range(1, len(WEIGHTS) + 1)])


def change_of(levels: list[Column]) -> Column:
    """The weighted change of four consecutive values, the latest first."""
    return reduce(
        lambda a, b: a + b,
        [F.coalesce(levels[i] - levels[i + 1], F.lit(0)) * w for i, w in enumerate(WEIGHTS)],
    )


def with_wma_growth(facts: DataFrame) -> DataFrame:
    """Add avg_growth_rate over the whole history; 0 without a usable previous row."""
    return facts.withColumn("avg_growth_rate", average_growth(weighted_change(), previous("total_enrolment")))


def average_growth(change: Column, before: Column) -> Column:
    return F.coalesce(ratio(change, sum(WEIGHTS) * before), F.lit(0.0))


def with_horizons(base: DataFrame, growth: str, horizons=HORIZONS) -> DataFrame:
    """One row per school and horizon with the compounded enrolment; growth is clamped for this only."""
    step = F.lit(1.0) + clamp(growth, -GROWTH_CAP, GROWTH_CAP)
    value = F.rint(F.col("base_enrolment") * F.pow("_step", "years_ahead")).cast("int")
    return (
        base.withColumn("_step", step)
        .select("*", F.explode(F.array(*[F.lit(k) for k in horizons])).alias("years_ahead"))
        .withColumn("projected_enrolment", F.when(F.col("base_enrolment").isNotNull(), F.greatest(F.lit(0), value)))
        .drop("_step")
    )


def with_projected_gaps(rows: DataFrame, truncate_label: bool = True) -> DataFrame:
    """Requirements, gaps against current capacity and the forecast-year label."""
    rooms = norm_requirement("projected_enrolment", norm("school_category", "forecast", "rooms"))
    teachers = norm_requirement("projected_enrolment", norm("school_category", "forecast", "teachers"))
    return rows.withColumns(
        {
            "forecast_year": shifted_year("base_year", "years_ahead", truncate_label),
            "projected_classrooms_req": rooms,
            "projected_teachers_req": teachers,
        }
    ).withColumns(
        {
            "projected_classroom_gap": shortfall("projected_classrooms_req", "current_classrooms"),
            "projected_teacher_gap": shortfall("projected_teachers_req", "current_teachers"),
        }
    )


def base_rows(facts: DataFrame, growth: str) -> DataFrame:
    """Rows of the base year in the column names of the forecast tables."""
    extra = [c for c in ("district",) if c in facts.columns]
    return facts.select(
        "school_id",
        *extra,
        F.col("academic_year").alias("base_year"),
        F.col("total_enrolment").alias("base_enrolment"),
        growth,
        F.coalesce("usable_class_rooms", F.lit(0)).alias("current_classrooms"),
        F.coalesce("total_teachers", F.lit(0)).alias("current_teachers"),
        F.coalesce("school_category", F.lit(DEFAULT_CATEGORY)).alias("school_category"),
    )


def wma_forecast(facts: DataFrame, year: str | None = None, horizons=HORIZONS) -> DataFrame:
    """Forecast rows (school x horizon) from the base year, the latest by default.

    Lags are taken over the full history before the base year is selected.
    """
    return (
        in_year(only(with_wma_growth(facts), "has_school"), year)
        .transform(base_rows, "avg_growth_rate")
        .transform(with_horizons, "avg_growth_rate", horizons)
        .transform(with_projected_gaps)
    )


def forecast_summary(forecast: DataFrame, growth: str = "avg_growth_rate", keyed: bool = False) -> DataFrame:
    """One row per base year: counts, labels, means and gap sums by horizon.

    `keyed` says that schools and years are known to be a key of the facts
    (`store.is_key`); each school then has one row at the first horizon.
    """
    first = F.when(F.col("years_ahead") == HORIZONS[0], F.col("school_id"))

    def at(k: int, gap: str) -> Column:
        return F.sum(F.when(F.col("years_ahead") == k, F.col(gap)).otherwise(0))

    return forecast.groupBy("base_year").agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.count(first) if keyed else F.countDistinct("school_id")).alias("unique_schools"),
        F.min("forecast_year").alias("first_forecast"),
        F.max("forecast_year").alias("last_forecast"),
        round_half_away(F.avg(growth), 4).alias("mean_growth"),
        round_half_away(F.avg("projected_enrolment"), 0).alias("avg_proj_enrolment"),
        F.sum("projected_classroom_gap").alias("total_proj_cr_gap"),
        F.sum("projected_teacher_gap").alias("total_proj_tr_gap"),
        *[at(k, "projected_classroom_gap").alias(f"yr{k}_cr_gap") for k in HORIZONS],
        *[at(k, "projected_teacher_gap").alias(f"yr{k}_tr_gap") for k in HORIZONS],
    )


def top_forecast_districts(
    forecast: DataFrame, growth: str = "avg_growth_rate", horizon: int = 3, k: int = 10
) -> DataFrame:
    """Districts by projected classroom gap at one horizon. Needs the district column."""
    totals = (
        forecast.where(F.col("years_ahead") == horizon)
        .groupBy("district")
        .agg(
            F.sum("projected_enrolment").alias("total_proj_enrolment"),
            F.sum("projected_classroom_gap").alias("total_proj_cr_gap"),
            F.sum("projected_teacher_gap").alias("total_proj_tr_gap"),
            round_half_away(F.avg(growth), 4).alias("avg_growth"),
        )
    )
    return top(totals, k, F.desc("total_proj_cr_gap"), "district")


def horizon_totals(forecast: DataFrame, growth: str = "avg_growth_rate") -> DataFrame:
    """Totals per horizon."""
    return forecast.groupBy("years_ahead", "forecast_year").agg(
        F.sum("projected_classroom_gap").alias("cr_gap"),
        F.sum("projected_teacher_gap").alias("tr_gap"),
        round_half_away(F.avg(as_col(growth)), 4).alias("mean_growth"),
        F.sum("projected_enrolment").alias("total_enrolment"),
    )
