"""Longitudinal analysis of the panel: churn, stability cohorts, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, ratio
from panelwise.functions.windows import in_year, previous
from panelwise.operators.ordered import exact_percentiles

# Most years of an "unstable" school.
UNSTABLE_MAX = 3


def year_list(panel: DataFrame) -> DataFrame:
    return panel.select("academic_year").distinct().orderBy("academic_year")


def panel_size(panel: DataFrame) -> DataFrame:
    """One row: sorted years and distinct schools."""
    return panel.agg(
        F.array_join(F.sort_array(F.collect_set("academic_year")), ",").alias("years"),
        F.countDistinct("school_id").alias("total_schools"),
    )


def schools_per_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy("academic_year").agg(F.countDistinct("school_id").alias("schools"))


def years_active(panel: DataFrame) -> DataFrame:
    return panel.groupBy("school_id").agg(F.countDistinct("academic_year").alias("years_active"))


def survival_distribution(panel: DataFrame) -> DataFrame:
    """Schools by number of years they appear in."""
    return years_active(panel).groupBy("years_active").agg(F.count(F.lit(1)).alias("schools")).orderBy("years_active")


def stability(years, full_years) -> Column:
    """stable in every year, unstable in few, mid otherwise."""
    years = as_col(years)
    return F.when(years <= UNSTABLE_MAX, "unstable").when(years == full_years, "stable").otherwise("mid")


def stability_labels(panel: DataFrame, full_years: int | None = None) -> DataFrame:
    """One row per school with its label."""
    full = F.lit(full_years) if full_years else panel.agg(F.countDistinct("academic_year")).scalar()
    return years_active(panel).withColumn("stability", stability("years_active", full))


def with_stability(panel: DataFrame, full_years: int | None = None) -> DataFrame:
    """Attach the label to every row.

    The set of a school's years is taken over the school window, so the label
    comes with the same exchange the growth lag needs instead of a join.
    """
    full = F.lit(full_years) if full_years else panel.agg(F.countDistinct("academic_year")).scalar()
    years = F.size(F.collect_set("academic_year").over(Window.partitionBy("school_id")))
    return panel.withColumn("years_active", years).withColumn("stability", stability("years_active", full))


def enrolment_by_stability(labelled: DataFrame, year: str | None = None) -> DataFrame:
    """Mean enrolment per label in one year."""
    return in_year(labelled, year).groupBy("stability").agg(F.avg("total_enrolment").alias("avg_enrolment"))


def stability_crosstab(
    labelled: DataFrame, column: str, values: list | None = None, year: str | None = None
) -> DataFrame:
    """Label x column counts in one year, zero-filled."""
    grouped = in_year(labelled, year).groupBy("stability")
    return grouped.pivot(column, values).count().fillna(0) if values else grouped.pivot(column).count().fillna(0)


def growth_panel(labelled: DataFrame, keep_infinite: bool = False) -> DataFrame:
    """Growth in percent against the previous row; rows without one are dropped.

    Growth after an enrolment of 0 is infinite and would turn every mean
    infinite; such rows are left out unless `keep_infinite`.
    """
    cur, prev = F.col("total_enrolment"), F.col("prev_enrolment")
    growth = ratio(cur - prev, prev) * 100
    if keep_infinite:
        jump = F.when(cur > 0, F.lit(float("inf"))).when(cur < 0, F.lit(float("-inf")))
        growth = F.when(prev == 0, jump).otherwise(growth)
    return (
        labelled.withColumn("prev_enrolment", previous("total_enrolment"))
        .withColumn("enrolment_growth_pct", growth)
        .where(F.col("enrolment_growth_pct").isNotNull())
    )


def mean_growth_by_stability(growth: DataFrame) -> DataFrame:
    return (
        growth.groupBy("stability")
        .agg(F.avg("enrolment_growth_pct").alias("avg_growth_pct"))
        .orderBy(F.desc("avg_growth_pct"), "stability")
    )


def median_growth_by_stability(growth: DataFrame, exact: bool = True) -> DataFrame:
    """Median growth per label; `exact=False` uses the bounded-memory estimate."""
    if exact:
        out = exact_percentiles(growth, ["stability"], "enrolment_growth_pct", {"median_growth_pct": 0.5})
    else:
        out = growth.groupBy("stability").agg(
            F.percentile_approx("enrolment_growth_pct", 0.5, 10_000).alias("median_growth_pct")
        )
    return out.orderBy(F.desc("median_growth_pct"), "stability")
