"""Windows and row-to-row helpers of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col, start_year


def by_school():
    """A school's rows in year order.

    One partition holds one school's years, so it is as small as the number of
    years, and every operator that uses this spec shares one exchange.
    """
    return Window.partitionBy("school_id").orderBy("academic_year")


def previous(col, steps: int = 1, calendar_adjacent: bool = False) -> Column:
    """Value `steps` rows earlier for the same school.

    "Earlier" is the previous available row. With `calendar_adjacent` the row
    must also lie exactly `steps` years back, otherwise the result is NULL.
    """
    value = F.lag(as_col(col), steps).over(by_school())
    if not calendar_adjacent:
        return value
    back = start_year(F.lag("academic_year", steps).over(by_school()))
    return F.when(start_year("academic_year") - back == steps, value)


def has(df: DataFrame, flag: str) -> Column:
    """Row-presence flag set by the fact join; frames without it count as complete."""
    return F.col(flag) if flag in df.columns else F.lit(True)


def only(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose presence flag is set (the inner-join rule)."""
    return df.where(F.col(flag)) if flag in df.columns else df


def in_year(df: DataFrame, year: str | None = None) -> DataFrame:
    """Rows of one academic year, the latest one when none is named.

    The latest year is a scalar subquery, so it reaches a partitioned table as
    a partition filter.
    """
    if year is not None:
        return df.where(F.col("academic_year") == F.lit(year))
    latest = df.select("academic_year").agg(F.max("academic_year")).scalar()
    return df.where(F.col("academic_year") == latest)


def in_latest_of_few(df: DataFrame, year: str | None = None) -> DataFrame:
    """As `in_year`, for roll-ups of districts by years: reads its input once.

    The latest year is a window over all rows, which a roll-up has few of; a
    scalar subquery would plan everything below the roll-up a second time.
    """
    if year is not None:
        return in_year(df, year)
    latest = F.max("academic_year").over(Window.partitionBy())
    return df.withColumn("_latest", latest).where(F.col("academic_year") == F.col("_latest")).drop("_latest")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """First k rows of a total order (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """First k rows per group; the rank filter is also applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= k).drop("_pos")
