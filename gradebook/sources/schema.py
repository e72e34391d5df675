"""Column names and types of the nine tables and of the change batches."""

from __future__ import annotations

TABLES = {
    "users": "id BIGINT, name STRING, email STRING, matric_number STRING, program STRING, role STRING",
    "courses": "id BIGINT, course_code STRING, course_name STRING, semester INT, year INT, created_at TIMESTAMP_NTZ",
    "course_user": "id BIGINT, user_id BIGINT, course_id BIGINT, role STRING",
    "assessments": "id BIGINT, course_id BIGINT, title STRING, type STRING, max_mark INT, weight INT, created_at TIMESTAMP_NTZ",
    "marks": "id BIGINT, assessment_id BIGINT, student_id BIGINT, mark_obtained BIGINT, created_at TIMESTAMP_NTZ",
    "final_exams": "id BIGINT, course_id BIGINT, student_id BIGINT, final_mark BIGINT, gpa DOUBLE",
    "remark_requests": "id BIGINT, student_id BIGINT, assessment_id BIGINT, message STRING, status STRING, created_at TIMESTAMP_NTZ",
    "notifications": "id BIGINT, user_id BIGINT, title STRING, message STRING, is_read INT, created_at TIMESTAMP_NTZ",
    "advisor_notes": "id BIGINT, advisor_id BIGINT, student_id BIGINT, course_id BIGINT, note STRING, meeting_date TIMESTAMP_NTZ",
}

BATCHES = {
    "marks": "seq BIGINT, assessment_id BIGINT, student_id BIGINT, mark_obtained DOUBLE",
    "finals": "seq BIGINT, course_id BIGINT, student_id BIGINT, final_mark DOUBLE, final_exam_weight DOUBLE",
    "remarks": "seq BIGINT, student_id BIGINT, assessment_id BIGINT, message STRING, status STRING",
    "enrolments": "seq BIGINT, id BIGINT, student_id BIGINT, course_id BIGINT",
    "assessments": "seq BIGINT, id BIGINT, course_id BIGINT, title STRING, type STRING, max_mark INT, weight INT, created_by BIGINT",
    "courses": "seq BIGINT, id BIGINT, course_code STRING, course_name STRING, semester INT, year INT",
    "users": "seq BIGINT, id BIGINT, name STRING, email STRING, matric_number STRING, program STRING, role STRING",
    "notes": "seq BIGINT, advisor_id BIGINT, student_id BIGINT, matric_number STRING, course_id BIGINT, note STRING, meeting_date TIMESTAMP_NTZ",
    "scenarios": "scenario_id BIGINT, student_id BIGINT, assessment_id BIGINT, mark_obtained DOUBLE",
}

#: The columns by which a stored table's files are ordered and its changes find their rows.
KEYS = {
    "users": ["id"], "courses": ["id"], "course_user": ["id"], "assessments": ["id"], "marks": ["assessment_id", "student_id"],
    "final_exams": ["course_id", "student_id"], "remark_requests": ["student_id", "assessment_id"], "notifications": ["id"],
    "advisor_notes": ["id"],
}
