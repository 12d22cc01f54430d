"""Norms: pupils per classroom and pupils per teacher by school category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.exprs import as_col

# Fixed values. (norm set, resource) -> ({norm: categories}, norm of all other categories)
NORMS = {
    ("current", "rooms"): ({30: [1, 2, 3, 6], 35: [4, 5, 7], 40: [8, 10, 11]}, 30),
    ("current", "teachers"): ({30: [1, 2, 3, 5, 6, 7, 8, 10, 11], 35: [4]}, 30),
    ("forecast", "rooms"): ({30: [1, 2, 3], 35: [4, 5]}, 40),
    ("forecast", "teachers"): ({30: [1, 2, 3, 4, 5]}, 35),
}

# Fixed value: category assumed by the forecasts when a school has none.
DEFAULT_CATEGORY = 6


def norm(category, norm_set: str, resource: str) -> Column:
    """Norm of a school category as a CASE expression."""
    by_norm, default = NORMS[(norm_set, resource)]
    category = as_col(category)
    expr = None
    for value, members in by_norm.items():
        if value == default:
            continue
        cond = category.isin(*members)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return F.lit(default) if expr is None else expr.otherwise(default)


def norms_frame(spark: SparkSession) -> DataFrame:
    """The norm sets as a table (norm_set, resource, category, norm)."""
    rows = [
        (norm_set, resource, category, value)
        for (norm_set, resource), (by_norm, _) in NORMS.items()
        for value, members in by_norm.items()
        for category in members
    ]
    return spark.createDataFrame(rows, "norm_set string, resource string, category int, norm int")
