"""Dashboard views over the report and the derived tables.

Each view is a set-level query; a district, block or school is a plain filter
and the year defaults to the latest. `keyed` says that school and year are known
to be a key of the report (`store.is_key`), so that schools are plain row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, count_if, exact_mean, pct, round_half_away, schools
from panelwise.functions.windows import in_latest_of_few, in_year, only, top, top_per
from panelwise.operators import search
from panelwise.operators.risk import LEVELS, level_counts


def rows_count() -> Column:
    return F.count(F.lit(1))


def pick(df: DataFrame, **values) -> DataFrame:
    """Keep rows equal to the given values; None means no restriction."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _blocks(report: DataFrame) -> DataFrame:
    return only(report, "has_school").withColumn("block", F.coalesce("block", F.lit("UNKNOWN")))


def _kpis(keyed: bool) -> list[Column]:
    return [
        schools(keyed).alias("total_schools"),
        *level_counts(),
        round_half_away(exact_mean("risk_score"), 4).alias("avg_risk_score"),
        F.sum("classroom_gap").alias("total_classroom_gap"),
        F.sum(F.coalesce("teacher_gap", F.lit(0))).alias("total_teacher_gap"),
    ]


def resolved() -> tuple[Column, Column, Column]:
    """(both gaps resolved, at least one, neither)"""
    rooms, teachers = F.col("classroom_resolved") == 1, F.col("teacher_resolved") == 1
    return rooms & teachers, rooms | teachers, ~rooms & ~teachers


def funding_status(partly: str) -> Column:
    both, either, _ = resolved()
    return F.when(both, "FUNDED").when(either, partly).otherwise("UNFUNDED")


# --- state ----------------------------------------------------------------------


def state_kpis(report: DataFrame, year: str | None = None, keyed: bool = False) -> DataFrame:
    """Schools, level counts, mean risk, gap sums and the share of critical schools."""
    return (
        in_year(report, year)
        .agg(*_kpis(keyed))
        .withColumn("critical_share_pct", pct("critical", "total_schools", 1))
    )


def state_budget(report: DataFrame, year: str | None = None) -> DataFrame:
    """Funded, partial and unfunded schools with allocated totals."""
    both, either, neither = resolved()
    return in_year(report, year).agg(
        count_if(both).alias("funded"),
        count_if(either & ~both).alias("partial"),
        count_if(neither).alias("unfunded"),
        F.sum("classrooms_allocated").alias("total_classrooms_allocated"),
        F.sum("teachers_allocated").alias("total_teachers_allocated"),
    )


def district_cards(index: DataFrame, year: str | None = None) -> DataFrame:
    """Index rows of one year by rank."""
    return in_latest_of_few(index, year).select(
        "district",
        "academic_year",
        "total_schools",
        "avg_risk_score",
        "compliance_grade",
        "district_rank",
        "yoy_risk_improvement",
        "pct_high_critical",
    ).orderBy("district_rank", "district")


def available_years(report: DataFrame) -> DataFrame:
    return report.select("academic_year").distinct().orderBy("academic_year")


def risk_by_year(report: DataFrame) -> DataFrame:
    return (
        report.groupBy("academic_year")
        .agg(round_half_away(exact_mean("risk_score"), 4).alias("avg_risk"), *level_counts(), rows_count().alias("total"))
        .orderBy("academic_year")
    )


def enrolment_by_year(report: DataFrame, keyed: bool = False) -> DataFrame:
    return (
        report.groupBy("academic_year")
        .agg(
            F.sum("total_enrolment").alias("total_enrolment"),
            schools(keyed).alias("school_count"),
        )
        .orderBy("academic_year")
    )


def allocation_by_status(report: DataFrame, year: str | None = None) -> DataFrame:
    rows = in_year(report, year).where(F.col("allocation_priority").isNotNull())
    return rows.groupBy(funding_status("PARTIALLY_FUNDED").alias("allocation_status")).agg(
        rows_count().alias("count"),
        F.sum("classrooms_allocated").alias("classrooms"),
        F.sum("teachers_allocated").alias("teachers"),
    )


def top_unfunded_districts(report: DataFrame, year: str | None = None, k: int = 10) -> DataFrame:
    rows = only(in_year(report, year), "has_school").where(resolved()[2])
    totals = rows.groupBy("district").agg(
        F.sum(F.col("classroom_gap") - F.col("classrooms_allocated")).alias("unfunded_cr_gap"),
        F.sum(F.col("teacher_gap") - F.col("teachers_allocated")).alias("unfunded_tr_gap"),
        rows_count().alias("schools"),
    )
    return top(totals, k, F.desc("unfunded_cr_gap"), "district")


# --- district ---------------------------------------------------------------------


def trend_arrow(delta) -> Column:
    """Direction shown next to a yearly change; none without one. The dead zone is a fixed value."""
    delta = as_col(delta)
    return F.when(delta < -0.01, "down").when(delta > 0.01, "up").when(delta.isNotNull(), "stable")


def district_list(index: DataFrame) -> DataFrame:
    return district_cards(index).withColumn("trend", trend_arrow("yoy_risk_improvement"))


def district_history(index: DataFrame, district: str | None = None) -> DataFrame:
    """All years of a district (or of all districts)."""
    return (
        pick(index, district=district)
        .select(
            "district",
            "academic_year",
            "compliance_grade",
            "avg_risk_score",
            "district_rank",
            "yoy_risk_improvement",
            "total_schools",
            "pct_high_critical",
        )
        .orderBy("district", "academic_year")
    )


def block_heatmap(report: DataFrame, district: str | None = None, year: str | None = None) -> DataFrame:
    """Blocks x risk levels with fixed level columns and a total over all rows."""
    rows = pick(_blocks(in_year(report, year)), district=district)
    return rows.groupBy("district", "block").agg(
        *[count_if(F.col("risk_level") == v).alias(v) for v in LEVELS], rows_count().alias("total")
    )


def priority_schools(report: DataFrame, district: str | None = None, year: str | None = None, k: int = 50) -> DataFrame:
    """First k TOP_5/TOP_10 schools of each district by state rank."""
    rows = pick(in_year(report, year), district=district).where(F.col("priority_bucket").isin("TOP_5", "TOP_10"))
    return top_per(
        rows.select(
            "district",
            "school_id",
            "school_name",
            "block",
            "risk_score",
            "state_rank",
            "priority_bucket",
            "persistent_high_risk_flag",
            "classroom_gap",
            "risk_level",
            F.coalesce("teacher_gap", F.lit(0)).alias("teacher_gap"),
        ),
        ["district"],
        k,
        "state_rank",
        "school_id",
    )


def decision_counts(judged: DataFrame, district: str | None = None, year: str | None = None) -> DataFrame:
    rows = pick(only(in_year(judged, year), "has_school"), district=district)
    return rows.groupBy("district", "decision_status").agg(rows_count().alias("count"))


def flagged_requests(judged: DataFrame, district: str | None = None, year: str | None = None, k: int = 30) -> DataFrame:
    """Flagged requests of each district by lowest confidence."""
    rows = pick(only(in_year(judged, year), "has_school"), district=district)
    rows = rows.where(F.col("decision_status") == "FLAGGED")
    return top_per(
        rows.select(
            "district",
            "school_id",
            "school_name",
            "block",
            "decision_status",
            "reason_code",
            "confidence_score",
            "classroom_ratio",
            "teacher_ratio",
        ),
        ["district"],
        k,
        "confidence_score",
        "school_id",
    )


# --- block ------------------------------------------------------------------------


def block_kpis(
    report: DataFrame,
    district: str | None = None,
    block: str | None = None,
    year: str | None = None,
    keyed: bool = False,
) -> DataFrame:
    """KPIs per block, with the number of fully funded schools."""
    rows = pick(_blocks(in_year(report, year)), district=district, block=block)
    return rows.groupBy("district", "block").agg(*_kpis(keyed), count_if(resolved()[0]).alias("funded_count"))


def block_schools(
    report: DataFrame,
    district: str | None = None,
    block: str | None = None,
    year: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Schools of a block by risk, with trend, flags and budget status; first `limit` of each block."""
    rows = pick(_blocks(in_year(report, year)), district=district, block=block)
    return top_per(
        rows.select(
            "district",
            "block",
            "school_id",
            "school_name",
            "school_category",
            "risk_score",
            "risk_level",
            "classroom_gap",
            F.coalesce("teacher_gap", F.lit(0)).alias("teacher_gap"),
            F.coalesce("trend_direction", F.lit("N/A")).alias("trend_direction"),
            F.coalesce("chronic_risk_flag", F.lit(0)).alias("is_chronic"),
            F.coalesce("volatile_flag", F.lit(0)).alias("is_volatile"),
            funding_status("PARTIAL").alias("budget_status"),
            "total_enrolment",
        ),
        ["district", "block"],
        limit,
        F.desc("risk_score"),
        "school_id",
    )


def chronic_schools(
    report: DataFrame, district: str | None = None, block: str | None = None, year: str | None = None
) -> DataFrame:
    rows = pick(_blocks(in_year(report, year)), district=district, block=block)
    return rows.where(F.col("chronic_risk_flag") == 1).select(
        "district",
        "block",
        "school_id",
        "school_name",
        "risk_score",
        F.col("chronic_risk_flag").alias("is_chronic"),
        F.col("volatile_flag").alias("is_volatile"),
        "trend_direction",
        "classroom_gap",
        F.coalesce("teacher_gap", F.lit(0)).alias("teacher_gap"),
    )


def volatile_schools(
    report: DataFrame,
    district: str | None = None,
    block: str | None = None,
    year: str | None = None,
    k: int = 30,
) -> DataFrame:
    """Volatile schools of each block by size of the last change."""
    rows = pick(_blocks(in_year(report, year)), district=district, block=block)
    return top_per(
        rows.where(F.col("volatile_flag") == 1).select(
            "district", "block", "school_id", "school_name", "risk_score", "risk_delta", "trend_direction"
        ),
        ["district", "block"],
        k,
        F.desc_nulls_last(F.abs("risk_delta")),
        "school_id",
    )


# --- school -----------------------------------------------------------------------


def school_profile(schools: DataFrame, school_id: str | None = None) -> DataFrame:
    return pick(schools, school_id=school_id).select(
        "school_id", "school_name", "district", "block", "school_category", "management_type"
    )


def _latest_row(report: DataFrame) -> DataFrame:
    newest = Window.partitionBy("school_id").orderBy(F.desc("academic_year"))
    return report.withColumn("_pos", F.row_number().over(newest)).where("_pos = 1").drop("_pos")


def latest_card(report: DataFrame, school_id: str | None = None) -> DataFrame:
    """Latest row of each school with defaults for what is unknown."""

    def known(name: str, default, as_name: str | None = None) -> Column:
        return F.coalesce(name, F.lit(default)).alias(as_name or name)

    return _latest_row(pick(report, school_id=school_id)).select(
        "school_id",
        "academic_year",
        "risk_score",
        "risk_level",
        "classroom_gap",
        "required_class_rooms",
        "usable_class_rooms",
        "teacher_deficit_ratio",
        "classroom_deficit_ratio",
        known("teacher_gap", 0),
        known("required_teachers", 0),
        known("total_teachers", 0),
        "total_enrolment",
        known("trend_direction", "N/A"),
        known("risk_delta", 0.0),
        known("chronic_risk_flag", 0, "is_chronic"),
        known("priority_bucket", "STANDARD"),
        known("persistent_high_risk_flag", 0, "persistent_high_risk"),
        known("state_rank", 0, "risk_rank"),
    )


def school_history(report: DataFrame, school_id: str | None = None) -> DataFrame:
    """Years of a school in order; of all schools as they come, as a total order of everything serves nobody."""
    rows = pick(report, school_id=school_id).select(
        "school_id",
        "academic_year",
        "total_enrolment",
        "risk_score",
        "risk_level",
        "classroom_gap",
        F.coalesce("teacher_gap", F.lit(0)).alias("teacher_gap"),
        F.coalesce("total_teachers", F.lit(0)).alias("total_teachers"),
        "usable_class_rooms",
    )
    return rows if school_id is None else rows.orderBy("academic_year")


def school_forecast(forecast: DataFrame, growth: str, school_id: str | None = None) -> DataFrame:
    return pick(forecast, school_id=school_id).select(
        "school_id",
        "forecast_year",
        "years_ahead",
        "base_enrolment",
        growth,
        "projected_enrolment",
        "projected_classroom_gap",
        "projected_teacher_gap",
    )


# Names of the checklist columns.
FACILITIES = {
    "drinking_water_available": "drinking_water",
    "electricity_available": "electricity",
    "internet_available": "internet",
    "separate_girls_toilet": "girls_toilet",
    "ramp_available": "ramp",
    "cwsn_toilet_available": "cwsn_toilet",
    "resource_room_available": "resource_room",
}


def facility_checklist(report: DataFrame, school_id: str | None = None) -> DataFrame:
    """Facilities and building condition of each school's latest year; unknown facilities stay NULL."""

    def flag(name: str) -> Column:
        return F.col(name) if name in report.columns else F.lit(None).cast("boolean")

    return _latest_row(pick(report, school_id=school_id)).select(
        "school_id",
        "academic_year",
        *[flag(name).alias(shown) for name, shown in FACILITIES.items()],
        "building_condition",
        "classroom_condition_score",
        "total_class_rooms",
        "usable_class_rooms",
    )


def search_schools(schools: DataFrame, text: str, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """Schools whose id or name contains the text, whatever the case.

    The text is matched as given: `%` and `_` are not wildcards. With an index
    (`search.postings`) only schools that hold all its trigrams are looked at.
    """
    needle = F.lower(F.lit(text))
    found = (
        search.search(schools, index, text)
        if index is not None
        else schools.where(F.contains(F.lower("school_id"), needle) | F.contains(F.lower("school_name"), needle))
    )
    return top(
        found.select("school_id", "school_name", "district", "block", "school_category"), limit, "school_id"
    )


def enrolment_series(report: DataFrame, learned: DataFrame, school_id: str | None = None) -> DataFrame:
    """History and learned forecast as one series."""
    past = pick(report, school_id=school_id).select(
        "school_id",
        F.col("academic_year").alias("year"),
        F.lit("Historical").alias("type"),
        F.col("total_enrolment").alias("enrolment"),
    )
    ahead = pick(learned, school_id=school_id).select(
        "school_id",
        F.col("forecast_year").alias("year"),
        F.lit("ML Forecast").alias("type"),
        F.col("projected_enrolment").alias("enrolment"),
    )
    return past.unionByName(ahead)


def forecast_pairs(averaged: DataFrame, learned: DataFrame, school_id: str | None = None) -> DataFrame:
    """Both projections side by side per horizon; a missing learned one shows 0."""
    left = pick(averaged, school_id=school_id).select(
        "school_id", "years_ahead", F.col("projected_enrolment").alias("wma")
    )
    right = pick(learned, school_id=school_id).select(
        "school_id", "years_ahead", F.col("projected_enrolment").alias("ml")
    )
    return left.join(right, ["school_id", "years_ahead"], "left").select(
        "school_id",
        F.concat(F.lit("T+"), F.col("years_ahead").cast("string")).alias("horizon"),
        "wma",
        F.coalesce("ml", F.lit(0)).alias("ml"),
    )


def gap_rows(report: DataFrame, school_id: str | None = None) -> DataFrame:
    """Latest gaps of each school as rows: one per resource."""
    resources = F.array(
        F.struct(
            F.lit("Classrooms").alias("name"),
            F.col("usable_class_rooms").alias("actual"),
            F.col("required_class_rooms").alias("required"),
            F.col("classroom_gap").alias("gap"),
        ),
        F.struct(
            F.lit("Teachers").alias("name"),
            F.coalesce("total_teachers", F.lit(0)).alias("actual"),
            F.coalesce("required_teachers", F.lit(0)).alias("required"),
            F.coalesce("teacher_gap", F.lit(0)).alias("gap"),
        ),
    )
    return _latest_row(pick(report, school_id=school_id)).select("school_id", "academic_year", F.inline(resources))


# --- figures the design describes --------------------------------------------------


def state_index(index: DataFrame) -> DataFrame:
    """Mean of the district index per year."""
    return index.groupBy("academic_year").agg(
        round_half_away(exact_mean("avg_risk_score"), 4).alias("state_risk"), rows_count().alias("districts")
    )


def critical_blocks(report: DataFrame, year: str | None = None, k: int = 10) -> DataFrame:
    """Blocks with the highest share of critical schools."""
    shares = (
        _blocks(in_year(report, year))
        .groupBy("district", "block")
        .agg(count_if(F.col("risk_level") == "CRITICAL").alias("critical"), rows_count().alias("total"))
        .withColumn("critical_share_pct", pct("critical", "total", 2))
    )
    return top(shares, k, F.desc("critical_share_pct"), "district", "block")


def growing_gap_warnings(report: DataFrame, forecast: DataFrame, horizon: int = 3) -> DataFrame:
    """Districts whose projected classroom gap exceeds today's; schools without a district count as UNKNOWN."""
    place = F.coalesce("district", F.lit("UNKNOWN")).alias("district")
    now = only(in_year(report), "has_school").groupBy(place).agg(F.sum("classroom_gap").alias("current_gap"))
    then = (
        forecast.where(F.col("years_ahead") == horizon)
        .groupBy(place)
        .agg(F.sum("projected_classroom_gap").alias("projected_gap"))
    )
    return now.join(then, "district").withColumn("warning", F.col("projected_gap") > F.col("current_gap"))


def block_level_shares(report: DataFrame, year: str | None = None) -> DataFrame:
    """Distribution of levels per block in percent."""
    rows = _blocks(in_year(report, year)).groupBy("district", "block").agg(*level_counts(), rows_count().alias("total"))
    return rows.select(
        "district", "block", "total", *[pct(v.lower(), "total", 2).alias(f"{v.lower()}_pct") for v in LEVELS]
    )
