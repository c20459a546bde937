"""Course progress, quizzes and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div
from tallyspark.plans.keyed import KeyedRows, any_of

PASS_SCORE = 70


def course_progress(done: DataFrame, lessons: DataFrame) -> DataFrame:
    """Progress per user and course.

    The latest score of a lesson counts.  Aggregates per lesson first, so a learner
    with many visits is reduced before the second grouping.
    """
    per_lesson = done.groupBy("user_id", "course_id", "lesson").agg(
        F.sum("minutes").alias("minutes"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.struct("ts", "id"))).alias("score"),
        F.max("ts").alias("ts"),
    )
    per_course = per_lesson.groupBy("user_id", "course_id").agg(
        F.count(F.lit(1)).alias("lessons_completed"),
        F.sum("minutes").alias("minutes"),
        F.avg("score").alias("average_score"),
        F.max("ts").alias("last_accessed"),
    )
    return per_course.join(lessons, "course_id", "left").withColumn(
        "completion", safe_div(F.col("lessons_completed") * 100, F.col("total_lessons"))
    )


def learner_overview(progress: DataFrame) -> DataFrame:
    complete = F.count_if(F.col("completion") >= 100)
    return progress.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("courses"),
        complete.alias("completed"),
        F.sum("minutes").alias("minutes"),
        (complete / F.count(F.lit(1)) * 100).alias("completion_rate"),
    )


def quiz_results(answers: DataFrame, key: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Score of each quiz attempt; unanswered or unknown questions count as wrong."""
    marked = KeyedRows(answers, list(on)).attach(key)
    right = F.count_if(F.coalesce(F.col("answer") == F.col("correct"), F.lit(False)))
    total = F.count(F.lit(1))
    return marked.groupBy(*by).agg(
        right.alias("right_answers"),
        total.alias("questions"),
        (right / total * 100).alias("score"),
        (right / total * 100 >= PASS_SCORE).alias("passed"),
    )


def catalogue(courses: DataFrame, difficulty: str | None = None, category: str | None = None) -> DataFrame:
    if difficulty is not None:
        courses = courses.filter(F.col("difficulty") == difficulty)
    return courses if category is None else courses.filter(F.col("category") == category)


def recommended(courses: DataFrame, level: str, interests: Sequence[str] = ()) -> DataFrame:
    """Courses of the level; with interests, those naming one in title or description."""
    fitting = courses.filter(F.col("difficulty") == level)
    if not interests:
        return fitting
    found = [F.lower(c).contains(i.lower()) for i in interests for c in ("title", "description")]
    return fitting.filter(any_of(found))
