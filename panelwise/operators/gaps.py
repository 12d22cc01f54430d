"""Norm-based resource gaps and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, count_if, ratio, round_half_away
from panelwise.functions.norms import norm
from panelwise.functions.windows import has, only, top


def norm_requirement(demand, norm_col):
    """ceil(demand / norm); NULL demand gives NULL."""
    return F.ceil(as_col(demand) / as_col(norm_col)).cast("int")


def shortfall(required, capacity):
    """max(required - capacity, 0); unknown capacity counts as 0, unknown requirement stays NULL."""
    required = as_col(required)
    return required - F.least(required, F.coalesce(as_col(capacity), F.lit(0)))


def with_room_gap(facts: DataFrame) -> DataFrame:
    """Add required_class_rooms and classroom_gap; rows without a school profile keep NULL."""
    need = norm_requirement("total_enrolment", norm("school_category", "current", "rooms"))
    return facts.withColumn("required_class_rooms", F.when(has(facts, "has_school"), need)).withColumn(
        "classroom_gap", shortfall("required_class_rooms", "usable_class_rooms")
    )


def with_teacher_gap(facts: DataFrame) -> DataFrame:
    """Add required_teachers and teacher_gap; rows without profile or teacher record keep NULL."""
    need = norm_requirement("total_enrolment", norm("school_category", "current", "teachers"))
    known = has(facts, "has_school") & has(facts, "has_teachers")
    return facts.withColumn("required_teachers", F.when(known, need)).withColumn(
        "teacher_gap", shortfall("required_teachers", "total_teachers")
    )


def with_gaps(facts: DataFrame) -> DataFrame:
    return facts.transform(with_room_gap).transform(with_teacher_gap)


def gap_summary(gapped: DataFrame, gap: str) -> DataFrame:
    """One row: records, records in deficit, mean positive gap (2 dp)."""
    positive = F.when(F.col(gap) > 0, F.col(gap))
    return gapped.agg(
        F.count(F.lit(1)).alias("total_records"),
        count_if(F.col(gap) > 0).alias("deficit_count"),
        round_half_away(ratio(F.sum(positive), F.count(positive)), 2).alias("avg_gap"),
    )


def top_gap_districts(gapped: DataFrame, gap: str, k: int = 10) -> DataFrame:
    """Districts by cumulative positive gap; names trimmed, blank names left out of the report."""
    named = only(gapped, "has_school").where(F.col(gap) > 0).withColumn("district", F.trim("district"))
    totals = (
        named.where(F.col("district") != "")
        .groupBy("district")
        .agg(F.sum(gap).alias("cumulative_gap"), F.count(F.lit(1)).alias("school_years"))
    )
    return top(totals, k, F.desc("cumulative_gap"), "district")
