import pytest

from panelwise.operators import proposals

BATCH = "school_id string, requested_classrooms int, requested_teachers int, classroom_gap int, teacher_gap int"


@pytest.mark.parametrize(
    "request_, gap, reason, status",
    [
        ((1, 0), (0, 5), "NO_DEFICIT", "REJECTED"),
        ((5, 1), (5, None), "NO_DEFICIT", "REJECTED"),
        ((16, 5), (10, 5), "CLASSROOM_OVER_REQUEST", "REJECTED"),
        ((10, 16), (10, 10), "TEACHER_OVER_REQUEST", "REJECTED"),
        ((15, 10), (10, 10), "CLASSROOM_MODERATE_OVER", "FLAGGED"),
        ((10, 13), (10, 10), "TEACHER_MODERATE_OVER", "FLAGGED"),
        ((4, 10), (10, 10), "CLASSROOM_UNDER_REQUEST", "FLAGGED"),
        ((5, 4), (10, 10), "TEACHER_UNDER_REQUEST", "FLAGGED"),
        ((0, 0), (10, 10), "NO_REQUEST", "ACCEPTED"),
        ((12, 5), (10, 10), "WITHIN_TOLERANCE", "ACCEPTED"),
    ],
)
def test_batch_rules(spark, request_, gap, reason, status):
    row = proposals.judge_batch(spark.createDataFrame([("s", *request_, *gap)], BATCH)).first()
    assert (row.reason_code, row.decision_status) == (reason, status)


def test_batch_numbers(spark):
    row = proposals.judge_batch(spark.createDataFrame([("s", 2, 0, 3, 0)], BATCH)).first()
    assert row.classroom_ratio == 0.6667 and row.teacher_ratio is None
    assert row.confidence_score == 0.8333


def test_perturbed_requests_round_exactly(spark):
    df = spark.createDataFrame(
        [(f"s{i}", "2020-21", i % 23 - 3, None if i % 5 == 0 else i % 17) for i in range(400)],
        "school_id string, academic_year string, classroom_gap int, teacher_gap int",
    )
    import zlib
    from decimal import ROUND_HALF_UP, Decimal

    for r in proposals.perturbed_requests(df).collect():
        for gap, req, salt in ((r.classroom_gap, r.requested_classrooms, "cr"), (r.teacher_gap, r.requested_teachers, "tr")):
            n = zlib.crc32(f"{r.school_id}{r.academic_year}{salt}".encode()) % 80
            want = Decimal(max(gap or 0, 0)) * (Decimal("0.7") + Decimal(n) / 100)
            assert req == int(want.quantize(Decimal(1), ROUND_HALF_UP))


SUB = (
    "submission_id bigint, school_id string, academic_year string, classrooms_requested int, teachers_requested int, "
    "justification string, submitted_by string"
)
GAPS = "school_id string, academic_year string, classroom_gap int, teacher_gap int, total_enrolment int"


@pytest.mark.parametrize(
    "request_, gap, reason, confidence",
    [
        ((1, 0), None, "SCHOOL_NOT_FOUND", 0.0),
        ((1, 0), (0, 0), "NO_DEFICIT", 0.1),
        ((1, 5), (0, 5), "CLASSROOM_OVER_REQUEST", 0.2),
        ((5, 1), (5, None), "TEACHER_OVER_REQUEST", 0.2),
        ((15, 10), (10, 10), "CLASSROOM_MODERATE_OVER", 0.5),
        ((12, 10), (10, 10), "CLASSROOM_MODERATE_OVER", 0.5),
        ((10, 12), (10, 10), "TEACHER_MODERATE_OVER", 0.5),
        ((4, 10), (10, 10), "CLASSROOM_UNDER_REQUEST", 0.6),
        ((5, 4), (10, 10), "TEACHER_UNDER_REQUEST", 0.6),
        ((0, 0), (0, None), "NO_REQUEST", 1.0),
        ((11, 5), (10, 10), "WITHIN_TOLERANCE", 0.7),
        ((0, 10), (0, 10), "WITHIN_TOLERANCE", 0.5),
    ],
)
def test_submission_rules(spark, request_, gap, reason, confidence):
    subs = spark.createDataFrame([(1, "s", "2020-21", *request_, None, None)], SUB)
    gaps = spark.createDataFrame([("s", "2020-21", *gap, 100)] if gap else [], GAPS)
    row = proposals.judge_submissions(subs, gaps).first()
    assert (row.reason_code, row.confidence_score) == (reason, confidence)
    assert row.decision_status == proposals.DECISION[reason]


def test_submission_ratio_is_null_where_it_would_be_infinite(spark):
    subs = spark.createDataFrame([(1, "s", "2020-21", 3, 2, None, None)], SUB)
    row = proposals.judge_submissions(subs, spark.createDataFrame([("s", "2020-21", 0, 2, 100)], GAPS)).first()
    assert row.classroom_ratio is None and row.teacher_ratio == 1.0


def test_range_rules_and_defaults(spark):
    subs = spark.createDataFrame(
        [(1, "s", "y", 0, 100, None, None), (2, "s", "y", 101, 0, "x", "me"), (3, "s", "y", -1, 0, None, None), (4, "s", "y", None, 0, None, None), (5, None, "y", 1, 1, None, None)],
        SUB,
    )
    valid, bad = proposals.split_valid(subs)
    row = valid.collect()
    assert [r.submission_id for r in row] == [1]
    assert (row[0].justification, row[0].submitted_by) == ("", "School Admin")
    assert sorted(r.submission_id for r in bad.collect()) == [2, 3, 4, 5]


def test_messages(spark):
    df = spark.createDataFrame(
        [("ACCEPTED", "NO_REQUEST"), ("FLAGGED", "TEACHER_UNDER_REQUEST"), ("REJECTED", "NO_DEFICIT")],
        "decision_status string, reason_code string",
    )
    assert [r.message for r in proposals.with_message(df).collect()] == [
        "Proposal accepted — within tolerance of actual gaps.",
        "Proposal flagged for manual review — teacher under request.",
        "Proposal rejected — no deficit.",
    ]
