import pytest
from pyspark.sql import functions as F

from panelwise.functions.norms import NORMS, norm, norms_frame
from panelwise.operators import gaps, risk

FACTS = (
    "school_id string, academic_year string, total_enrolment int, usable_class_rooms int, total_teachers int, "
    "district string, school_category int"
)


def facts(spark, rows, extra=""):
    return spark.createDataFrame(rows, FACTS + extra)


@pytest.mark.parametrize(
    "enrolment, rooms, want",
    [(None, 5, (None, None)), (0, 5, (0, 0)), (30, None, (1, 1)), (31, 0, (2, 2)), (31, 9, (2, 0)), (600, 7, (20, 13))],
)
def test_room_gap(spark, enrolment, rooms, want):
    df = facts(spark, [("a", "2020-21", enrolment, rooms, 1, "D", 1)])
    row = gaps.with_gaps(df).first()
    assert (row.required_class_rooms, row.classroom_gap) == want


def test_rows_without_profile_or_teacher_record_keep_null(spark):
    df = facts(
        spark,
        [("a", "2020-21", 90, 1, 1, None, None, False, True), ("b", "2020-21", 90, 1, None, "D", 1, True, False)],
        ", has_school boolean, has_teachers boolean",
    )
    a, b = risk.with_risk(gaps.with_gaps(df)).orderBy("school_id").collect()
    assert a.classroom_gap is None and a.teacher_gap is None and a.risk_score == 0.0
    assert b.classroom_gap == 2 and b.teacher_gap is None
    assert b.classroom_deficit_ratio is None and b.teacher_deficit_ratio is None


@pytest.mark.parametrize("norm_set, resource", list(NORMS))
def test_norm_table_and_expression_agree(spark, norm_set, resource):
    table = {r.category: r.norm for r in norms_frame(spark).collect() if (r.norm_set, r.resource) == (norm_set, resource)}
    cats = spark.createDataFrame([(c,) for c in [*range(1, 12), None]], "c int")
    default = NORMS[(norm_set, resource)][1]
    for r in cats.select("c", norm("c", norm_set, resource).alias("n")).collect():
        assert r.n == table.get(r.c, default)


def test_growth_rules(spark):
    rows = [("a", f"20{y}-{y + 1}", e, 1, 1, "D", 1) for y, e in ((10, 0), (11, 50), (13, 75), (14, None))]
    got = risk.with_growth(facts(spark, rows)).orderBy("academic_year").collect()
    assert [r.enrolment_growth_rate for r in got] == [0.0, 0.0, 0.5, None]
    strict = risk.with_growth(facts(spark, rows), calendar_adjacent=True).orderBy("academic_year").collect()
    assert [r.enrolment_growth_rate for r in strict] == [0.0, 0.0, 0.0, None]


@pytest.mark.parametrize(
    "tdr, cdr, growth, score, level",
    [
        (1.0, 1.0, -3.0, 0.9, "CRITICAL"),
        (None, None, None, 0.0, "LOW"),
        (0.0, 0.0, 0.9, 0.1, "LOW"),
        (1.0, 0.0, 0.25, 0.5, "MODERATE"),
        (1.0, 0.0001 / 0.35, 0.25, 0.5001, "HIGH"),
        (1.0, 0.00003 / 0.35, 0.25, 0.5, "HIGH"),
    ],
)
def test_score_and_level(spark, tdr, cdr, growth, score, level):
    df = spark.createDataFrame(
        [(tdr, cdr, growth)],
        "teacher_deficit_ratio double, classroom_deficit_ratio double, enrolment_growth_rate double",
    )
    row = risk.with_score(df).first()
    assert (row.risk_score, row.risk_level) == (score, level)


def test_ratio_is_null_without_requirement_and_capped(spark):
    df = spark.createDataFrame(
        [(5, 0, 9, 3)], "classroom_gap int, required_class_rooms int, teacher_gap int, required_teachers int"
    )
    row = risk.with_deficit_ratios(df).first()
    assert row.classroom_deficit_ratio is None and row.teacher_deficit_ratio == 1.0


def test_blank_districts_stay_out_of_the_report(spark):
    df = spark.createDataFrame(
        [("  A ", 5), ("A", 2), ("  ", 50), (None, 60), ("B", 0)], "district string, classroom_gap int"
    )
    got = [tuple(r) for r in gaps.top_gap_districts(df, "classroom_gap").collect()]
    assert got == [("A", 7, 2)]


def test_score_bound_covers_all_scores():
    assert risk.RiskModel().distinct_scores == 9002
