"""From the wide panel to the four normalised tables, by declared column maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import flag_to_bool, safe_float, safe_int, safe_str

# Target column <- (source column or None, kind).
SCHOOL_MAP = {
    "school_name": (None, "str"),
    "district": ("district", "str"),
    "block": ("block", "str"),
    "management_type": ("managment", "str"),
    "school_category": ("school_category", "int"),
    "latitude": (None, "float"),
    "longitude": (None, "float"),
}
YEARLY_MAP = {
    "total_enrolment": ("total_enrolment", "int"),
    "attendance_rate": (None, "float"),
}
INFRA_MAP = {
    "total_class_rooms": ("total_class_rooms", "int"),
    "usable_class_rooms": ("classrooms_in_good_condition", "int"),
    "building_condition": ("building_status", "str50"),
    "drinking_water_available": ("drinking_water_available", "flag"),
    "electricity_available": ("electricity_availability", "flag"),
    "internet_available": ("internet", "flag"),
    "separate_girls_toilet": ("separate_girls_toilet", "flag"),
    "ramp_available": ("availability_ramps", "flag"),
    "resource_room_available": ("resource_room_available", "flag"),
    "last_major_repair_year": (None, "int"),
}

_TYPES = {"str": "string", "str50": "string", "int": "int", "float": "double", "flag": "boolean"}
_CASTS = {
    "str": safe_str,
    "str50": lambda c: safe_str(c, 50),
    "int": safe_int,
    "float": safe_float,
    "flag": flag_to_bool,
}


def source(df: DataFrame, name: str | None) -> Column:
    """The source column, or NULL when the map names none or the frame lacks it."""
    return F.col(name) if name is not None and name in df.columns else F.lit(None).cast("string")


def mapped(df: DataFrame, column_map: dict) -> list[Column]:
    """Typed projection of a column map."""
    return [
        _CASTS[kind](source(df, name)).cast(_TYPES[kind]).alias(target)
        for target, (name, kind) in column_map.items()
    ]


def keys(df: DataFrame) -> list[Column]:
    return [
        F.col("school_id").cast("string").alias("school_id"),
        safe_str(source(df, "year"), 20).alias("academic_year"),
    ]


def condition_score(df: DataFrame) -> Column:
    """2 x major + 1 x minor repairs; NULL only when both are missing."""
    major, minor = source(df, "classrooms_needs_major_repair"), source(df, "classrooms_needs_minor_repair")
    score = F.coalesce(safe_int(major), F.lit(0)) * 2 + F.coalesce(safe_int(minor), F.lit(0))
    return F.when(major.isNotNull() | minor.isNotNull(), score)


def special_toilet(df: DataFrame) -> Column:
    """True when either toilet works; NULL when both are unknown, false otherwise."""
    boys, girls = safe_int(source(df, "func_boys_cwsn_friendly")), safe_int(source(df, "func_girls_cwsn_friendly"))
    yes = F.coalesce(boys == 1, F.lit(False)) | F.coalesce(girls == 1, F.lit(False))
    return F.when(boys.isNotNull() | girls.isNotNull(), yes)


def split_unkeyed(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a school id, rows without). The tables require the key, so the rest is set aside."""
    return panel.where(F.col("school_id").isNotNull()), panel.where(F.col("school_id").isNull())


def schools_table(panel: DataFrame) -> DataFrame:
    """One row per school from its latest year; district and block names trimmed."""
    profile = panel.select(F.col("school_id").cast("string"), safe_str(source(panel, "year"), 20).alias("_year"), *mapped(panel, SCHOOL_MAP))
    rest = [F.asc_nulls_last(c) for c in SCHOOL_MAP]
    newest = Window.partitionBy("school_id").orderBy(F.desc_nulls_last("_year"), *rest)
    return profile.withColumn("_pos", F.row_number().over(newest)).where("_pos = 1").drop("_pos", "_year")


def yearly_table(panel: DataFrame) -> DataFrame:
    return panel.select(*keys(panel), *mapped(panel, YEARLY_MAP))


def infra_table(panel: DataFrame) -> DataFrame:
    return panel.select(
        *keys(panel),
        *mapped(panel, INFRA_MAP),
        condition_score(panel).alias("classroom_condition_score"),
        special_toilet(panel).alias("cwsn_toilet_available"),
        F.lit(None).cast("int").alias("required_class_rooms"),
    )


def teacher_table(panel: DataFrame) -> DataFrame:
    """Teacher counts; the newer column wins where both exist."""
    count = F.coalesce(safe_int(source(panel, "total_tch")), safe_int(source(panel, "total_teacher")))
    return panel.select(
        *keys(panel), count.alias("total_teachers"), F.lit(None).cast("int").alias("required_teachers")
    )


def split_panel(panel: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the normalised model."""
    keyed, _ = split_unkeyed(panel)
    return {
        "schools": schools_table(keyed),
        "yearly_metrics": yearly_table(keyed),
        "infrastructure_details": infra_table(keyed),
        "teacher_metrics": teacher_table(keyed),
    }


def load_summary(panel: DataFrame, year: str = "year") -> DataFrame:
    """One row: distinct schools, school-year rows, sorted years."""
    return panel.agg(
        F.countDistinct("school_id").alias("total_schools"),
        F.count(F.lit(1)).alias("school_year_rows"),
        F.array_join(F.sort_array(F.collect_set(year)), ",").alias("academic_years"),
    )


def join_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """One wide row per school-year, the input of all analytical operators.

    The three fact tables come from one panel and share their keys; the
    presence flags keep the difference between inner and left joins visible to
    the operators when a table lacks rows. All joins lead with school_id.
    """
    on = ["school_id", "academic_year"]
    infra = tables["infrastructure_details"].drop("required_class_rooms")
    yearly = tables["yearly_metrics"]
    teachers = tables["teacher_metrics"].drop("required_teachers").withColumn("has_teachers", F.lit(True))
    schools = tables["schools"].withColumn("has_school", F.lit(True))
    wide = infra.join(yearly, on, "left").join(teachers, on, "left").join(schools, "school_id", "left")
    return wide.withColumns(
        {flag: F.coalesce(flag, F.lit(False)) for flag in ("has_teachers", "has_school")}
    )
