"""Capped allocation in priority order, and what-if scenarios over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, count_if, pct, round_half_away
from panelwise.functions.windows import in_year, only, top, top_per
from panelwise.operators.ordered import running_totals
from panelwise.operators.risk import LEVELS

# Default budget, unit cost and teacher posts; rupees per crore and per lakh.
CLASSROOM_BUDGET = 500_000_000
COST_PER_CLASSROOM = 500_000
TEACHER_POSTS = 10_000
CRORE = 10_000_000
LAKH = 100_000


def fill(gap, running, cap) -> Column:
    """Units given to a row: its gap while the running total fits, the rest of the cap at the boundary, else 0."""
    gap, running, cap = as_col(gap), as_col(running), as_col(cap)
    return F.least(gap, F.greatest(F.lit(0), cap - (running - gap))).cast("int")


def _queue(scored: DataFrame) -> DataFrame:
    """Rows that take part: scored, with a teacher record; unknown gaps count as 0."""
    level_order = F.lit(len(LEVELS) + 1)
    for i, level in reversed(list(enumerate(LEVELS, start=1))):
        level_order = F.when(F.col("risk_level") == level, i).otherwise(level_order)
    return (
        only(scored, "has_teachers")
        .where(F.col("risk_score").isNotNull())
        .withColumn("classroom_gap", F.coalesce("classroom_gap", F.lit(0)))
        .withColumn("teacher_gap", F.coalesce("teacher_gap", F.lit(0)))
        .withColumn("_level_order", level_order)
    )


def with_allocation(
    scored: DataFrame,
    classroom_budget: int = CLASSROOM_BUDGET,
    cost_per_classroom: int = COST_PER_CLASSROOM,
    teacher_posts: int = TEACHER_POSTS,
) -> DataFrame:
    """Fill both caps per year by level, then score; equal scores draw lots by id hash.

    A row is resolved while the running total is within the cap, so a zero-gap
    school past the cut-off is not.
    """
    rooms_cap = classroom_budget // cost_per_classroom
    queued = running_totals(
        _queue(scored),
        "academic_year",
        {"_level_order": False, "risk_score": True},
        ["classroom_gap", "teacher_gap"],
        "allocation_priority",
    )
    rooms, teachers = F.col("classroom_gap_running"), F.col("teacher_gap_running")
    return queued.withColumns(
        {
            "classrooms_allocated": fill("classroom_gap", rooms, F.lit(rooms_cap)),
            "teachers_allocated": fill("teacher_gap", teachers, F.lit(teacher_posts)),
            "classroom_resolved": (rooms <= rooms_cap).cast("int"),
            "teacher_resolved": (teachers <= teacher_posts).cast("int"),
        }
    ).drop("_level_order", "classroom_gap_running", "teacher_gap_running")


def allocation_table(scored: DataFrame, **caps) -> DataFrame:
    """The published allocation table."""
    return with_allocation(scored, **caps).select(
        "school_id",
        "academic_year",
        "risk_level",
        "classroom_gap",
        "teacher_gap",
        "classrooms_allocated",
        "teachers_allocated",
        "classroom_resolved",
        "teacher_resolved",
        "allocation_priority",
    )


def allocation_summary(allocated: DataFrame) -> DataFrame:
    """One row: allocated, resolved, and what remains open."""

    def left(gap: str, given: str) -> Column:
        return F.sum(F.greatest(F.col(gap) - F.col(given), F.lit(0)))

    return allocated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum("classrooms_allocated").alias("total_classrooms_alloc"),
        F.sum("teachers_allocated").alias("total_teachers_alloc"),
        F.sum("classroom_resolved").alias("schools_classroom_resolved"),
        F.sum("teacher_resolved").alias("schools_teacher_resolved"),
        left("classroom_gap", "classrooms_allocated").alias("remaining_classroom_deficit"),
        left("teacher_gap", "teachers_allocated").alias("remaining_teacher_deficit"),
    )


def district_coverage(allocated: DataFrame, k: int = 10) -> DataFrame:
    """Districts by share of school-years whose classroom gap is resolved. Needs the district column."""
    n = F.count(F.lit(1))
    totals = (
        only(allocated, "has_school")
        .groupBy("district")
        .agg(
            n.alias("school_years"),
            F.sum("classroom_resolved").alias("cr_resolved"),
            pct(F.sum("classroom_resolved"), n, 1).alias("cr_coverage_pct"),
            F.sum("teacher_resolved").alias("tr_resolved"),
            pct(F.sum("teacher_resolved"), n, 1).alias("tr_coverage_pct"),
        )
    )
    return top(totals, k, F.desc("cr_coverage_pct"), "district")


# --- what-if scenarios -----------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """One what-if: budget in crore, classroom cost in lakh, teacher posts."""

    name: str = "default"
    total_budget_cr: float = 50.0
    cost_per_classroom_lakh: float = 5.0
    max_teachers: int = 10_000

    def __post_init__(self):
        for field, low, high in (
            ("total_budget_cr", 1, 500),
            ("cost_per_classroom_lakh", 1, 50),
            ("max_teachers", 100, 100_000),
        ):
            if not low <= getattr(self, field) <= high:
                raise ValueError(f"{field} must lie in {low}..{high}")

    @property
    def unit_cost(self) -> float:
        return self.cost_per_classroom_lakh * LAKH

    @property
    def max_classrooms(self) -> int:
        return int(self.total_budget_cr * CRORE / self.unit_cost)


def scenario_rows(scored: DataFrame, scenarios: list[Scenario], year: str | None = None) -> DataFrame:
    """School x scenario rows of one year with allocation, cost and outcome.

    Running totals do not depend on the caps, so they are computed once and
    every scenario is arithmetic on top of them.
    """
    queued = running_totals(
        in_year(only(scored, "has_school").where(F.col("risk_score").isNotNull()), year)
        .withColumn("classroom_gap", F.coalesce("classroom_gap", F.lit(0)))
        .withColumn("teacher_gap", F.coalesce("teacher_gap", F.lit(0))),
        "academic_year",
        {"risk_score": True},
        ["classroom_gap", "teacher_gap"],
        "queue_position",
    )
    options = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.max_classrooms).alias("max_classrooms"),
                F.lit(s.max_teachers).alias("max_teachers"),
                F.lit(float(s.unit_cost)).alias("unit_cost"),
                F.lit(float(s.total_budget_cr)).alias("total_budget_cr"),
            )
            for s in scenarios
        ]
    )
    rooms, teachers = F.col("classrooms_allocated"), F.col("teachers_allocated")
    served = (rooms > 0) | (teachers > 0)
    met = (rooms >= F.col("classroom_gap")) & (teachers >= F.col("teacher_gap"))
    return (
        queued.select("*", F.inline(options))
        .withColumn("classrooms_allocated", fill("classroom_gap", "classroom_gap_running", "max_classrooms"))
        .withColumn("teachers_allocated", fill("teacher_gap", "teacher_gap_running", "max_teachers"))
        .withColumn("cost", rooms * F.col("unit_cost"))
        .withColumn(
            "outcome", F.when(served & met, "funded").when(served, "partially_funded").otherwise("unfunded")
        )
    )


def scenario_summary(rows: DataFrame) -> DataFrame:
    """One row per scenario: outcome counts, totals, cost in crore, use of the budget, coverage."""
    cost = F.sum("cost")
    counted = rows.groupBy("scenario", "max_classrooms", "max_teachers", "total_budget_cr").agg(
        *[
            count_if(F.col("outcome") == o).alias(o)
            for o in ("funded", "partially_funded", "unfunded")
        ],
        F.count(F.lit(1)).alias("total_schools"),
        F.sum("classrooms_allocated").alias("classrooms_allocated"),
        F.sum("teachers_allocated").alias("teachers_allocated"),
        cost.alias("_cost"),
    )
    return (
        counted.withColumn("total_cost_cr", round_half_away(F.col("_cost") / CRORE, 2))
        .withColumn(
            "budget_utilisation_pct",
            round_half_away(F.col("_cost") / (F.col("total_budget_cr") * CRORE) * 100, 1),
        )
        .withColumn("coverage_pct", pct(F.col("funded") + F.col("partially_funded"), "total_schools", 1))
        .drop("_cost")
    )


def scenario_districts(rows: DataFrame, k: int = 15) -> DataFrame:
    """Per scenario, the districts that receive most classrooms."""
    served = (F.col("classrooms_allocated") > 0) | (F.col("teachers_allocated") > 0)
    totals = (
        only(rows, "has_school")
        .groupBy("scenario", "district")
        .agg(
            F.sum("classrooms_allocated").alias("classrooms"),
            F.sum("teachers_allocated").alias("teachers"),
            F.sum("cost").alias("cost"),
            count_if(served).alias("schools_served"),
        )
    )
    return top_per(totals, ["scenario"], k, F.desc("classrooms"), "district")
