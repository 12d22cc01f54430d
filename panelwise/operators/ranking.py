"""Priority ranking of school-years and the persistent high-risk flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import count_if
from panelwise.functions.windows import only, previous, top
from panelwise.operators.ordered import score_ranks
from panelwise.operators.risk import HIGH_LEVELS

# Bucket name and the largest percent rank it takes.
BUCKETS = (("TOP_5", 0.05), ("TOP_10", 0.10), ("TOP_20", 0.20))
REST = "STANDARD"


def consecutive_high(run: int = 3, calendar_adjacent: bool = False) -> Column:
    """1 when this row and the run-1 rows before it are all HIGH or CRITICAL, else 0."""
    return all_high([F.col("risk_level")] + [previous("risk_level", i, calendar_adjacent) for i in range(1, run)])


def all_high(levels: list[Column]) -> Column:
    """1 when all levels are HIGH or CRITICAL, else 0."""
    return reduce(lambda a, b: a & b, [F.coalesce(v.isin(HIGH_LEVELS), F.lit(False)) for v in levels]).cast("int")


def with_persistent_flag(scored: DataFrame, run: int = 3, calendar_adjacent: bool = False) -> DataFrame:
    return scored.withColumn("persistent_high_risk_flag", consecutive_high(run, calendar_adjacent))


def with_ranks(scored: DataFrame) -> DataFrame:
    """Add state_rank, district_rank and priority_bucket per year; rows without a score drop out."""
    ranked = score_ranks(
        only(scored, "has_school").where(F.col("risk_score").isNotNull()),
        "risk_score",
        "academic_year",
        "district",
    )
    bucket = None
    for name, bound in BUCKETS:
        cond = F.col("percent_rank") <= bound
        bucket = F.when(cond, name) if bucket is None else bucket.when(cond, name)
    return ranked.withColumn("priority_bucket", bucket.otherwise(REST))


def priority_index(scored: DataFrame) -> DataFrame:
    """The published ranking table."""
    return (
        scored.transform(with_persistent_flag)
        .transform(with_ranks)
        .select(
            "school_id",
            "academic_year",
            "risk_score",
            "state_rank",
            "district_rank",
            "persistent_high_risk_flag",
            "priority_bucket",
        )
    )


def bucket_summary(priority: DataFrame) -> DataFrame:
    """One row: records per bucket and persistent total."""
    names = {"TOP_5": "top5", "TOP_10": "top10", "TOP_20": "top20", REST: "standard"}
    return priority.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[count_if(F.col("priority_bucket") == b).alias(a) for b, a in names.items()],
        F.sum("persistent_high_risk_flag").alias("persistent_count"),
    )


def top_priority_districts(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Districts by number of TOP_5/TOP_10 school-years. Needs the district column."""
    totals = ranked.groupBy("district").agg(
        F.count(F.lit(1)).alias("school_years"),
        count_if(F.col("priority_bucket").isin("TOP_5", "TOP_10")).alias("high_priority_count"),
        F.sum("persistent_high_risk_flag").alias("persistent_count"),
    )
    return top(totals, k, F.desc("high_priority_count"), "district")
