"""Change batches computed from the tables by fixed rules, in Spark and in SQL.

Each grows with the tables. ``SQL`` holds the batches as statements that run
unchanged in Spark and as CTEs of the checking SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from gradebook.sources.schema import TABLES
from gradebook.sources.tables import Gradebook

BATCH_TS = "2024-01-15 08:00:00"

SQL = {
    # Approved rechecks add a mark (none stays none), then lift low marks to 50;
    # a student advised about a course gets 40 for its exercise; some get a half more, which whole marks cannot hold.
    "marks_batch": """
        SELECT m.id AS seq, m.assessment_id, m.student_id, CAST(m.mark_obtained + 1 AS DOUBLE) AS mark_obtained
        FROM marks m JOIN remark_requests r ON r.id = m.id WHERE r.status = 'approved'
        UNION ALL SELECT m.id + 1000000000000000, m.assessment_id, m.student_id, 50.0E0
        FROM marks m JOIN remark_requests r ON r.id = m.id WHERE r.status = 'approved' AND m.mark_obtained < 50
        UNION ALL SELECT n.id + 2000000000000000, a.id, n.student_id, 40.0E0
        FROM advisor_notes n JOIN assessments a ON a.course_id = n.course_id WHERE a.type = 'exercise'
        UNION ALL SELECT id + 3000000000000000, assessment_id, student_id, mark_obtained + 0.5E0 FROM marks WHERE id % 33 = 0""",
    # A student is enrolled in every course of their advisor notes.
    "enrol_batch": """
        SELECT id AS seq, student_id, course_id FROM advisor_notes WHERE course_id IS NOT NULL""",
    # Low and missing marks ask for a recheck, the missing ones without a message; the lowest ask twice.
    "remarks_batch": """
        SELECT id AS seq, student_id, assessment_id,
         CASE WHEN mark_obtained IS NULL THEN '  ' ELSE ' please recheck ' END AS message
        FROM marks WHERE mark_obtained IS NULL OR mark_obtained < 20
        UNION ALL SELECT id + 1000000000000000, student_id, assessment_id, 'again' FROM marks WHERE mark_obtained < 10""",
    # Pending requests are approved; the best marks get a closed request.
    "remark_edits": """
        SELECT id AS seq, student_id, assessment_id, 'seen' AS message, 'approved' AS status
        FROM remark_requests WHERE status = 'pending'
        UNION ALL SELECT id + 1000000000000000, student_id, assessment_id, 'checked', 'rejected' FROM marks WHERE mark_obtained >= 90""",
    "courses_batch": """
        SELECT id AS seq, id, course_code, concat(course_name, ' (rev)') AS course_name, semester, year + 1 AS year
        FROM courses WHERE semester = 1""",
    "new_courses": """
        SELECT id AS seq, concat('N', course_code) AS course_code, course_name, semester, year FROM courses""",
    "users_batch": """
        SELECT id AS seq, id, concat(name, ' jr') AS name, email, matric_number,
         CAST(NULL AS VARCHAR(10)) AS program, role FROM users WHERE program = 'MACHINERY' OR role = 'advisor'""",
    "new_users": """
        SELECT id AS seq, name, CASE WHEN role = 'student' THEN '' ELSE concat('new-', email) END AS email,
         matric_number, program, role FROM users WHERE matric_number IS NULL""",
    "roles_batch": """
        SELECT id AS seq, id, CASE WHEN role = 'advisor' THEN 'lecturer' ELSE 'advisor' END AS role
        FROM users WHERE role <> 'student'""",
    "unassign_batch": """
        SELECT assessment_id, student_id FROM marks WHERE mark_obtained IS NULL
        UNION ALL SELECT assessment_id, student_id + 2000000000 FROM marks WHERE mark_obtained < 5""",
    "note_ids": """
        SELECT id FROM advisor_notes WHERE course_id IS NULL
        UNION ALL SELECT id + 1000000000000 FROM advisor_notes WHERE note = '1-URGENT'""",
    # Failed students move to the next course, unmarked ones hand over to the next student,
    # the best keep their course; the last part names unknown enrolments.
    "move_batch": """
        SELECT cu.id AS seq, cu.id, CASE WHEN f.gpa IS NULL THEN cu.user_id + 1 ELSE cu.user_id END AS student_id,
         CASE WHEN f.gpa = 4.0 THEN cu.course_id ELSE cu.course_id % 25 + 1 END AS course_id
        FROM course_user cu JOIN final_exams f ON f.id = cu.id WHERE f.gpa IS NULL OR f.gpa = 1.0 OR f.gpa = 4.0
        UNION ALL SELECT id + 5000000000000, id + 5000000000000, student_id, course_id FROM final_exams WHERE gpa = 1.5""",
    "withdraw_ids": """
        SELECT cu.id FROM course_user cu JOIN final_exams f ON f.id = cu.id WHERE f.gpa IS NULL
        UNION ALL SELECT id + 5000000000000 FROM final_exams WHERE gpa = 1.0""",
    # Every enrolment gets an exam mark, with the exam weight of the course's year; unmarked ones get a second.
    "finals_batch": """
        SELECT cu.id AS seq, cu.course_id, cu.user_id AS student_id,
         CAST((cu.user_id * 7 + cu.course_id * 13) % 101 AS DOUBLE) AS final_mark,
         CASE c.year WHEN 2023 THEN 30.0E0 WHEN 2024 THEN 25.0E0 END AS final_exam_weight
        FROM course_user cu JOIN courses c ON c.id = cu.course_id WHERE cu.role = 'student'
        UNION ALL SELECT id + 1000000000000000, course_id, student_id, 55.0E0, 20.0E0 FROM final_exams WHERE gpa IS NULL""",
    "notes_batch": """
        SELECT id AS seq, advisor_id, concat('A', lpad(CAST(student_id AS VARCHAR(10)), 7, '0')) AS matric_number,
         course_id, CASE WHEN note = '5-LOW' THEN '' ELSE note END AS note,
         CASE WHEN course_id IS NULL THEN NULL ELSE meeting_date END AS meeting_date FROM advisor_notes""",
    "notes_by_id": """
        SELECT id AS seq, CASE WHEN note = '1-URGENT' THEN 0 ELSE advisor_id END AS advisor_id, student_id, course_id,
         note, CASE WHEN course_id IS NULL THEN NULL ELSE meeting_date END AS meeting_date FROM advisor_notes""",
    # An insert per note (also of weight 0 or below), edits that lower, raise or keep a weight, moves to the next
    # course, moves on and back, a second edit that is always refused, and unknown ids.
    "assessments_batch": """
        SELECT id * 8 AS seq, CAST(NULL AS BIGINT) AS id, coalesce(course_id, student_id % 25 + 1) AS course_id,
         'Extra' AS title, 'quiz' AS type, CAST(50 AS INT) AS max_mark, CAST(id % 9 - CASE WHEN id % 11 = 0 THEN 9 ELSE 0 END AS INT) AS weight
        FROM advisor_notes
        UNION ALL SELECT id * 200 + 1, id, course_id, concat(title, ' (rev)'), type, max_mark,
         CAST(CASE type WHEN 'assignment' THEN weight - 4 WHEN 'lab' THEN weight - 9 WHEN 'exercise' THEN weight + 3 ELSE weight END AS INT)
        FROM assessments WHERE title <> 'Assessment 6'
        UNION ALL SELECT id * 200 + 2, id, course_id % 25 + 1, title, type, max_mark, weight
        FROM assessments WHERE title = 'Assessment 6' OR type = 'lab'
        UNION ALL SELECT id * 200 + 3, id, CASE WHEN type = 'lab' THEN course_id ELSE (course_id + 1) % 25 + 1 END, title, type, max_mark,
         CAST(weight + 1 AS INT) FROM assessments WHERE title = 'Assessment 6' OR type = 'lab'
        UNION ALL SELECT id * 200 + 4, id, course_id, title, type, max_mark, CAST(75 AS INT) FROM assessments WHERE type = 'assignment'
        UNION ALL SELECT id * 200 + 5, id + 5000000000000, course_id, title, type, max_mark, weight FROM assessments WHERE type = 'quiz'""",
    # Marks of which some lack a key or a place in the order, some share one, and some are no whole numbers.
    "unclear_marks": """
        SELECT CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 < 3 THEN id - id % 7 + 1 ELSE id END AS seq,
         CASE WHEN id % 11 = 0 THEN NULL ELSE assessment_id END AS assessment_id,
         CASE WHEN id % 13 = 0 THEN NULL ELSE student_id END AS student_id,
         mark_obtained + CASE WHEN id % 17 = 0 THEN 0.5E0 ELSE 0.0E0 END AS mark_obtained FROM marks""",
    # Lines of marks: some are texts, some no numbers, some no whole ones; some lack their student, some are cut off.
    "mark_lines": """
        SELECT concat(chr(123), '"seq": ', CAST(id AS VARCHAR(20)), ', "assessment_id": ', CAST(assessment_id AS VARCHAR(20)),
         CASE WHEN id % 7 = 0 THEN '' ELSE concat(', "student_id": ', CAST(student_id AS VARCHAR(20))) END, ', "mark_obtained": ',
         CASE WHEN mark_obtained IS NULL THEN 'null' WHEN id % 5 = 0 THEN '"abc"' WHEN id % 5 = 1 THEN concat('" ', CAST(mark_obtained AS VARCHAR(20)), ' "')
          WHEN id % 5 = 2 THEN concat(CAST(mark_obtained AS VARCHAR(20)), '.5') ELSE CAST(mark_obtained AS VARCHAR(20)) END,
         CASE WHEN id % 19 = 0 THEN '' ELSE chr(125) END) AS value FROM marks""",
    # Tables with broken keys: courses and users are missing, marks repeat, students are unknown.
    "broken_users": """
        SELECT * FROM users WHERE id % 13 <> 0""",
    "broken_courses": """
        SELECT * FROM courses WHERE id % 6 <> 0""",
    "broken_marks": """
        SELECT * FROM marks UNION ALL SELECT id + 5000000000000, assessment_id, student_id, mark_obtained, created_at FROM marks WHERE id % 29 = 0
        UNION ALL SELECT id, assessment_id + 900000, student_id, mark_obtained, created_at FROM marks WHERE id % 31 = 0""",
    "broken_final_exams": """
        SELECT id, course_id, CASE WHEN id % 17 = 0 THEN NULL ELSE student_id END AS student_id, final_mark, gpa FROM final_exams""",
    # Every ungraded mark supposed to be 40; every mark supposed to be one better.
    "scenarios": """
        SELECT CAST(1 AS BIGINT) AS scenario_id, student_id, assessment_id, 40.0E0 AS mark_obtained
        FROM marks WHERE mark_obtained IS NULL
        UNION ALL SELECT CAST(2 AS BIGINT), student_id, assessment_id, CAST(mark_obtained + 1 AS DOUBLE)
        FROM marks WHERE mark_obtained IS NOT NULL""",
    "matric_list": """
        SELECT matric_number FROM users WHERE matric_number IS NOT NULL
        UNION ALL SELECT concat('X', CAST(id AS VARCHAR(20))) FROM users WHERE role <> 'student'""",
    "header_pairs": """
        SELECT DISTINCT student_id, course_id FROM advisor_notes WHERE course_id IS NOT NULL""",
}

_TABLE = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")


def batch(db: Gradebook, name: str) -> DataFrame:
    """The batch as a DataFrame over the tables of ``db``."""
    used = {table: getattr(db, table) for _, table in _TABLE.findall(SQL[name])}
    return db.spark.sql(_TABLE.sub(r"\1 {\2}", SQL[name]), **used)
