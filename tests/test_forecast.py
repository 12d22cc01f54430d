import pytest
from pyspark.sql import functions as F

from panelwise.operators import forecast


def test_worked_example(spark):
    base = spark.createDataFrame(
        [("s", "2024-25", 500, -0.05, 10, 12, 1)],
        "school_id string, base_year string, base_enrolment int, avg_growth_rate double, current_classrooms int, "
        "current_teachers int, school_category int",
    )
    rows = base.transform(forecast.with_horizons, "avg_growth_rate").transform(forecast.with_projected_gaps)
    got = rows.orderBy("years_ahead").collect()
    assert [r.projected_enrolment for r in got] == [475, 451, 429]
    assert [r.projected_classrooms_req for r in got] == [16, 16, 15]
    assert [r.projected_classroom_gap for r in got] == [6, 6, 5]
    assert [r.projected_teacher_gap for r in got] == [4, 4, 3]
    assert [r.forecast_year for r in got] == ["2025-26", "2026-27", "2027-28"]


@pytest.mark.parametrize(
    "levels, want",
    [
        ([100], 0.0),
        ([100, 110], 3 * 10 / 600),
        ([90, 100, 110], (30 + 20) / 600),
        ([70, 90, 100, 110], (30 + 20 + 20) / 600),
        ([0, 110], 0.0),
        ([100, 500], 1200 / 600),
    ],
)
def test_weighted_growth(spark, levels, want):
    df = spark.createDataFrame(
        [("s", f"20{10 + i}-{11 + i}", v) for i, v in enumerate(levels)],
        "school_id string, academic_year string, total_enrolment int",
    )
    got = forecast.with_wma_growth(df).orderBy(F.desc("academic_year")).first().avg_growth_rate
    assert got == pytest.approx(want)


def test_growth_is_clamped_for_projection_but_stored_as_is(spark):
    df = spark.createDataFrame(
        [("s", "2010-11", 100, None, None, None), ("s", "2011-12", 500, None, None, None), ("t", "2010-11", 80, 1, 1, 1)],
        "school_id string, academic_year string, total_enrolment int, usable_class_rooms int, total_teachers int, school_category int",
    )
    got = forecast.wma_forecast(df).orderBy("years_ahead").collect()
    assert {r.school_id for r in got} == {"s"} and len(got) == 3
    assert got[0].avg_growth_rate == 2.0 and [r.projected_enrolment for r in got] == [650, 845, 1098]
    assert got[0].school_category == 6 and got[0].projected_classrooms_req == 17
    assert got[0].projected_classroom_gap == 17
