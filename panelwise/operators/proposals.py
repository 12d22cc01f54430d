"""Resource requests: reproducible perturbed requests and two rule sets that judge them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.exprs import count_if, exact_mean, hash_number, ratio, round_half_away
from panelwise.functions.windows import in_year, only, top

# Fixed values of the batch rule set.
OVER, MODERATE, UNDER = 1.5, 1.2, 0.5
NOISE_LOW_PCT, NOISE_STEPS = 70, 80

# Decision that goes with each reason.
DECISION = {
    "SCHOOL_NOT_FOUND": "REJECTED",
    "NO_DEFICIT": "REJECTED",
    "CLASSROOM_OVER_REQUEST": "REJECTED",
    "TEACHER_OVER_REQUEST": "REJECTED",
    "CLASSROOM_MODERATE_OVER": "FLAGGED",
    "TEACHER_MODERATE_OVER": "FLAGGED",
    "CLASSROOM_UNDER_REQUEST": "FLAGGED",
    "TEACHER_UNDER_REQUEST": "FLAGGED",
    "NO_REQUEST": "ACCEPTED",
    "WITHIN_TOLERANCE": "ACCEPTED",
}

# Fixed values of the submission rule set: confidence by reason, request range.
SUBMISSION_CONFIDENCE = {
    "SCHOOL_NOT_FOUND": 0.0,
    "NO_DEFICIT": 0.1,
    "CLASSROOM_OVER_REQUEST": 0.2,
    "TEACHER_OVER_REQUEST": 0.2,
    "CLASSROOM_MODERATE_OVER": 0.5,
    "TEACHER_MODERATE_OVER": 0.5,
    "CLASSROOM_UNDER_REQUEST": 0.6,
    "TEACHER_UNDER_REQUEST": 0.6,
    "NO_REQUEST": 1.0,
}
REQUEST_RANGE = (0, 100)


def decision_of(reason: Column) -> Column:
    """Decision status of a reason code, by lookup."""
    pairs = [F.lit(v) for pair in DECISION.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), reason)


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    expr = F.when(rules[0][0], rules[0][1])
    for cond, name in rules[1:]:
        expr = expr.when(cond, name)
    return expr.otherwise(otherwise)


def positive(gap: str) -> Column:
    """The gap where there is one, else 0."""
    return F.greatest(F.coalesce(F.col(gap), F.lit(0)), F.lit(0))


# --- batch ---------------------------------------------------------------------


def perturbed_requests(gapped: DataFrame, hash_method: str = "crc32") -> DataFrame:
    """Requests between 0.70 and 1.49 times the positive gap, fixed by a hash of school and year.

    The product is rounded in whole hundredths, so halves go up exactly.
    """

    def request(gap: str, salt: str) -> Column:
        noise = hash_number(hash_method, "school_id", "academic_year", F.lit(salt)) % NOISE_STEPS
        return F.floor((positive(gap) * (NOISE_LOW_PCT + noise) + 50) / 100).cast("int")

    return gapped.withColumns(
        {
            "requested_classrooms": request("classroom_gap", "cr"),
            "requested_teachers": request("teacher_gap", "tr"),
        }
    )


def judge_batch(requests: DataFrame) -> DataFrame:
    """Ratios, reason, decision and confidence for rows that carry requests and gaps.

    The first matching rule wins; both sides are checked at each step.
    """
    sides = (
        ("CLASSROOM", "requested_classrooms", "classroom_gap"),
        ("TEACHER", "requested_teachers", "teacher_gap"),
    )
    no_deficit = reduce(
        lambda a, b: a | b,
        [(F.coalesce(F.col(gap), F.lit(0)) <= 0) & (F.col(req) > 0) for _, req, gap in sides],
    )

    def against(req: str, gap: str, test) -> Column:
        return (F.col(req) > 0) & (F.col(gap) > 0) & test(F.col(req), F.col(gap))

    tests = (
        ("OVER_REQUEST", lambda r, g: r > g * OVER),
        ("MODERATE_OVER", lambda r, g: r > g * MODERATE),
        ("UNDER_REQUEST", lambda r, g: r < g * UNDER),
    )
    rules = [(no_deficit, "NO_DEFICIT")]
    rules += [
        (against(req, gap, test), f"{side}_{suffix}") for suffix, test in tests for side, req, gap in sides
    ]
    rules += [((F.col("requested_classrooms") == 0) & (F.col("requested_teachers") == 0), "NO_REQUEST")]

    off = reduce(
        lambda a, b: a + b, [F.abs(F.lit(1.0) - F.coalesce(c, F.lit(1.0))) for c in ("_rooms", "_teachers")]
    )
    return (
        requests.withColumns(
            {
                "actual_classroom_gap": positive("classroom_gap"),
                "actual_teacher_gap": positive("teacher_gap"),
                "reason_code": first_match(rules, "WITHIN_TOLERANCE"),
            }
        )
        .withColumns(
            {
                "_rooms": ratio("requested_classrooms", "actual_classroom_gap"),
                "_teachers": ratio("requested_teachers", "actual_teacher_gap"),
                "decision_status": decision_of(F.col("reason_code")),
            }
        )
        .withColumn("_confidence", F.greatest(F.lit(0.0), F.lit(1.0) - off / 2.0))
        .withColumns(
            {
                "classroom_ratio": round_half_away("_rooms", 4),
                "teacher_ratio": round_half_away("_teachers", 4),
                "confidence_score": round_half_away("_confidence", 4),
            }
        )
        .drop("_rooms", "_teachers", "_confidence")
    )


def validation_table(gapped: DataFrame, hash_method: str = "crc32") -> DataFrame:
    """The published batch validation table."""
    return (
        perturbed_requests(gapped, hash_method)
        .transform(judge_batch)
        .select(
            "school_id",
            "academic_year",
            "requested_classrooms",
            "requested_teachers",
            "actual_classroom_gap",
            "actual_teacher_gap",
            "classroom_ratio",
            "teacher_ratio",
            "decision_status",
            "reason_code",
            "confidence_score",
        )
    )


def _statuses() -> list[Column]:
    return [
        count_if(F.col("decision_status") == s).alias(s.lower()) for s in ("ACCEPTED", "FLAGGED", "REJECTED")
    ]


def validation_summary(judged: DataFrame) -> DataFrame:
    """One row: decisions, mean confidence, five reason counts."""
    reasons = {
        "NO_DEFICIT": "no_deficit",
        "CLASSROOM_OVER_REQUEST": "cr_over",
        "TEACHER_OVER_REQUEST": "tr_over",
        "WITHIN_TOLERANCE": "within_tol",
        "NO_REQUEST": "no_request",
    }
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        *_statuses(),
        round_half_away(exact_mean("confidence_score"), 4).alias("avg_confidence"),
        *[count_if(F.col("reason_code") == code).alias(name) for code, name in reasons.items()],
    )


def top_rejecting_districts(judged: DataFrame, k: int = 10, year: str | None = None) -> DataFrame:
    """Districts of one year by rejected requests. Needs the district column."""
    totals = (
        only(in_year(judged, year), "has_school")
        .groupBy("district")
        .agg(
            F.count(F.lit(1)).alias("proposals"),
            *_statuses(),
            round_half_away(exact_mean("confidence_score"), 4).alias("avg_conf"),
        )
    )
    return top(totals, k, F.desc("rejected"), "district")


# --- submissions ---------------------------------------------------------------


def with_validity(submissions: DataFrame) -> DataFrame:
    """Add is_valid: both requests present and inside the allowed range; fill text defaults."""
    low, high = REQUEST_RANGE
    ok = [
        F.coalesce(F.col(c).between(low, high), F.lit(False))
        for c in ("classrooms_requested", "teachers_requested")
    ]
    keyed = F.col("school_id").isNotNull() & F.col("academic_year").isNotNull()
    return submissions.withColumns(
        {
            "justification": F.coalesce("justification", F.lit("")),
            "submitted_by": F.coalesce("submitted_by", F.lit("School Admin")),
            "is_valid": keyed & ok[0] & ok[1],
        }
    )


def split_valid(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted for validation, quarantined)."""
    checked = with_validity(submissions)
    return checked.where("is_valid").drop("is_valid"), checked.where(~F.col("is_valid")).drop("is_valid")


def judge_submissions(submissions: DataFrame, gapped: DataFrame) -> DataFrame:
    """Validate submissions against the gap table; batch or streaming on the left side.

    A left join finds the school-year, so unknown ones keep a row. Ratios are
    NULL where there is a request but no gap.
    """
    gaps = gapped.select(
        "school_id",
        "academic_year",
        F.lit(True).alias("_found"),
        F.coalesce("classroom_gap", F.lit(0)).alias("classroom_gap"),
        F.coalesce("teacher_gap", F.lit(0)).alias("teacher_gap"),
        "total_enrolment",
    )
    joined = submissions.join(gaps, ["school_id", "academic_year"], "left")
    cr, tr = F.col("classrooms_requested"), F.col("teachers_requested")
    cr_gap, tr_gap = F.col("classroom_gap"), F.col("teacher_gap")

    # A ratio exists where there is a gap; a request without a gap exceeds every bound.
    def share(req: Column, gap: Column) -> Column:
        return F.when(gap > 0, ratio(req, gap)).when(req == 0, F.lit(0.0))

    cr_share, tr_share = F.col("classroom_ratio"), F.col("teacher_ratio")
    cr_unmet, tr_unmet = (cr_gap <= 0) & (cr > 0), (tr_gap <= 0) & (tr > 0)
    rules = [
        (F.col("_found").isNull(), "SCHOOL_NOT_FOUND"),
        ((cr_gap == 0) & (tr_gap == 0) & ((cr > 0) | (tr > 0)), "NO_DEFICIT"),
        ((cr_share > OVER) | cr_unmet, "CLASSROOM_OVER_REQUEST"),
        ((tr_share > OVER) | tr_unmet, "TEACHER_OVER_REQUEST"),
        (cr_share.between(MODERATE, OVER), "CLASSROOM_MODERATE_OVER"),
        (tr_share.between(MODERATE, OVER), "TEACHER_MODERATE_OVER"),
        ((cr_share < UNDER) & (cr_gap > 0), "CLASSROOM_UNDER_REQUEST"),
        ((tr_share < UNDER) & (tr_gap > 0), "TEACHER_UNDER_REQUEST"),
        ((cr == 0) & (tr == 0) & (cr_gap == 0) & (tr_gap == 0), "NO_REQUEST"),
    ]
    close = F.lit(1.0) - F.abs(cr_share - 1.0) * 0.5 - F.abs(tr_share - 1.0) * 0.5
    confidence = round_half_away("_close", 3)
    for reason, value in SUBMISSION_CONFIDENCE.items():
        confidence = F.when(F.col("reason_code") == reason, F.lit(value)).otherwise(confidence)
    found = F.col("_found").isNotNull()
    return (
        joined.withColumns(
            {
                "classroom_ratio": F.when(found, share(cr, cr_gap)),
                "teacher_ratio": F.when(found, share(tr, tr_gap)),
            }
        )
        .withColumns(
            {
                "reason_code": first_match(rules, "WITHIN_TOLERANCE"),
                "_close": F.greatest(F.lit(0.0), F.least(F.lit(1.0), close)),
            }
        )
        .withColumns({"decision_status": decision_of(F.col("reason_code")), "confidence_score": confidence})
        .drop("_found", "_close")
    )


def with_message(judged: DataFrame) -> DataFrame:
    """Add the reply text of a decision."""
    reason = F.lower(F.replace(F.col("reason_code"), F.lit("_"), F.lit(" ")))
    status = F.col("decision_status")
    # Message formats.
    message = (
        F.when(status == "ACCEPTED", F.lit("Proposal accepted — within tolerance of actual gaps."))
        .when(status == "FLAGGED", F.concat(F.lit("Proposal flagged for manual review — "), reason, F.lit(".")))
        .when(status == "REJECTED", F.concat(F.lit("Proposal rejected — "), reason, F.lit(".")))
        .otherwise(F.lit(""))
    )
    return judged.withColumn("message", message)


def submission_history(stored: DataFrame, school_id: str | None = None) -> DataFrame:
    """Stored submissions of a school, newest first; all of them, without an order, when none is named."""
    if school_id is None:
        return stored
    return stored.where(F.col("school_id") == school_id).orderBy(F.desc("submitted_at"), F.desc("submission_id"))
