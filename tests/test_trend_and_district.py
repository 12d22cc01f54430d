import pytest
from pyspark.sql import functions as F

from panelwise.operators import district, ranking, trend
from panelwise.plans.views import trend_arrow

SCORED = "school_id string, academic_year string, risk_score double, risk_level string"


def history(spark, rows):
    return spark.createDataFrame([("s", f"20{y}-{y + 1}", v, lv) for y, v, lv in rows], SCORED)


def test_trend_columns(spark):
    df = history(
        spark,
        [(10, 0.30, "MODERATE"), (11, 0.625, "HIGH"), (12, None, None), (13, 0.5, "MODERATE"), (15, 0.375, "MODERATE")],
    )
    got = trend.risk_trend(df).orderBy("academic_year").collect()
    assert [r.trend_direction for r in got] == ["BASELINE", "DETERIORATING", "IMPROVING", "IMPROVING"]
    assert [r.prev_risk_score for r in got] == [None, 0.30, 0.625, 0.5]
    assert [r.year_over_year_count for r in got] == [1, 2, 3, 4]
    assert [r.volatile_flag for r in got] == [0, 1, 1, 0]
    assert got[1].cumulative_avg_risk == pytest.approx(0.4625)


def test_exact_steps_are_not_trends(spark):
    df = history(spark, [(10, 0.5, "HIGH"), (11, 0.25, "MODERATE"), (12, 0.25, "MODERATE")])
    model = trend.TrendModel(step=0.25, volatile_step=0.25)
    got = trend.risk_trend(df, model).orderBy("academic_year").collect()
    assert [r.trend_direction for r in got] == ["BASELINE", "STABLE", "STABLE"]
    assert [r.volatile_flag for r in got] == [0, 0, 0]


def test_run_of_three_counts_rows_or_calendar_years(spark):
    df = history(spark, [(10, 0.6, "HIGH"), (11, 0.8, "CRITICAL"), (13, 0.6, "HIGH"), (14, 0.1, "LOW"), (15, 0.6, "HIGH")])
    flags = ranking.with_persistent_flag(df).orderBy("academic_year").collect()
    assert [r.persistent_high_risk_flag for r in flags] == [0, 0, 1, 0, 0]
    strict = ranking.with_persistent_flag(df, calendar_adjacent=True).orderBy("academic_year").collect()
    assert [r.persistent_high_risk_flag for r in strict] == [0, 0, 0, 0, 0]


@pytest.mark.parametrize("mean, want", [(0.15, "A"), (0.1501, "B"), (0.30, "B"), (0.5, "C"), (0.75, "D"), (0.76, "F"), (None, "F")])
def test_grades(spark, mean, want):
    df = spark.createDataFrame([(mean,)], "m double")
    assert df.select(district.grade("m")).first()[0] == want


def test_district_index(spark):
    rows = [
        ("a", "2020-21", None, 0.2, "LOW", 2, -1, 10, 1),
        ("b", "2020-21", "X", 0.6, "HIGH", 0, 3, 20, None),
        ("c", "2020-21", "X", 0.3, "MODERATE", 5, None, 30, 4),
        ("b", "2021-22", "X", 0.35, "MODERATE", 1, 1, 20, 2),
        ("z", "2021-22", "X", None, None, 9, 9, 99, 9),
    ]
    df = spark.createDataFrame(
        rows,
        "school_id string, academic_year string, district string, risk_score double, risk_level string, "
        "classroom_gap int, teacher_gap int, total_enrolment int, classroom_condition_score int",
    )
    got = {(r.district, r.academic_year): r for r in district.district_index(df).collect()}
    assert got[("UNKNOWN", "2020-21")].total_teacher_deficit == 0
    x = got[("X", "2020-21")]
    assert (x.total_schools, x.avg_risk_score, x.pct_high_critical, x.district_rank) == (2, 0.45, 50.0, 1)
    assert (x.total_classroom_deficit, x.total_teacher_deficit, x.total_enrolment) == (5, 3, 50)
    assert x.avg_classroom_condition == 4.0 and x.yoy_risk_improvement is None
    later = got[("X", "2021-22")]
    assert later.total_schools == 1 and later.yoy_risk_improvement == pytest.approx(-0.1)


def test_trend_arrow(spark):
    df = spark.createDataFrame([(-0.02,), (0.02,), (0.01,), (None,)], "d double")
    assert [r[0] for r in df.select(trend_arrow("d")).collect()] == ["down", "up", "stable", None]
