import pytest
from pyspark.sql import functions as F

from panelwise.functions import exprs as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def test_least_and_greatest_propagate_null(spark):
    null = F.lit(None).cast("double")
    assert one(spark, X.sql_least(null, F.lit(1.0))) is None
    assert one(spark, X.sql_greatest(null, F.lit(0.0))) is None
    assert one(spark, X.sql_least(F.lit(0.5), F.lit(1.0))) == 0.5
    assert one(spark, X.clamp(null, -1.0, 1.0)) is None
    assert one(spark, X.clamp(F.lit(7.0), -1.0, 1.0)) == 1.0


def test_ratio_never_divides_by_zero(spark):
    assert one(spark, X.ratio(F.lit(3), F.lit(0))) is None
    assert one(spark, X.ratio(F.lit(3), F.lit(2))) == 1.5


@pytest.mark.parametrize("value, digits, want", [(0.05625, 4, 0.0563), (-0.125, 2, -0.13), (2.5, 0, 3.0), (-0.00001, 4, 0.0)])
def test_rounding_is_half_away_from_zero(spark, value, digits, want):
    assert one(spark, X.round_half_away(F.lit(value), digits)) == want


@pytest.mark.parametrize("text, want", [("3.7", 3), (" 12 ", 12), ("x", None), ("", None), (None, None), ("NaN", None), ("3.0", 3)])
def test_safe_int(spark, text, want):
    assert one(spark, X.safe_int(F.lit(text).cast("string"))) == want


def test_safe_str_trims_cuts_and_blanks(spark):
    assert one(spark, X.safe_str(F.lit("  abc  "), 2)) == "ab"
    assert one(spark, X.safe_str(F.lit("   "))) is None


@pytest.mark.parametrize("code, want", [("1", True), ("1.0", True), ("2", False), ("0", False), ("x", None), (None, None)])
def test_flag_codes(spark, code, want):
    assert one(spark, X.flag_to_bool(F.lit(code).cast("string"))) is want


def test_year_labels(spark):
    assert one(spark, X.shifted_year(F.lit("2024-25"), F.lit(3))) == "2027-28"
    assert one(spark, X.shifted_year(F.lit("2098-99"), F.lit(1))) == "2099-10"
    assert one(spark, X.shifted_year(F.lit("2098-99"), F.lit(1), truncate=False)) == "2099-100"
    assert one(spark, X.shifted_year(F.lit("2004-05"), F.lit(1))) == "2005-06"


def test_exact_mean_of_nothing_is_null(spark):
    assert spark.createDataFrame([], "x double").agg(X.exact_mean("x")).first()[0] is None


def test_hash_number(spark):
    import hashlib
    import zlib

    assert one(spark, X.hash_number("crc32", F.lit("7"), F.lit("cr"))) == zlib.crc32(b"7cr")
    assert one(spark, X.hash_number("md5", F.lit("7"), F.lit("cr"))) == int(hashlib.md5(b"7cr").hexdigest()[:8], 16)
    with pytest.raises(ValueError):
        X.hash_number("other", F.lit("7"))
