"""Declared schemas of the normalised and derived tables."""

from __future__ import annotations

SCHOOLS = (
    "school_id string, school_name string, district string, block string, management_type string, "
    "school_category int, latitude double, longitude double"
)
YEARLY_METRICS = "school_id string, academic_year string, total_enrolment int, attendance_rate double"
TEACHER_METRICS = "school_id string, academic_year string, total_teachers int, required_teachers int"
SUBMISSIONS = (
    "submission_id bigint, school_id string, academic_year string, classrooms_requested int, "
    "teachers_requested int, justification string, submitted_by string, submitted_at timestamp_ntz"
)
