"""Queries over forum and learning data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.exprs import age_label
from tallyspark.operators import forum, learning
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table
from tallyspark.sources.views import EVENTS_AS_OF

_CATEGORIES = ["General Discussion", "Investing & Trading", "Personal Finance", "Cryptocurrency"]

_THREADS_SQL = f"""
threads AS (SELECT conv_id AS thread_id, arg_min(text, turn) AS title, ['tag' || conv_id % 9, CASE WHEN count(*) > 6 THEN 'Long' ELSE 'Short' END] AS tags,
  ({_CATEGORIES!r})[1 + conv_id % 4] AS category, sum(length(text))::BIGINT AS views, max(TIMESTAMP '{EVENTS_AS_OF}' - to_minutes(CAST(conv_id * 60 - turn * 7 AS BIGINT))) AS last_activity
  FROM conversations GROUP BY conv_id)
"""


def _threads(spark, folder):
    posts = views.posts(spark, folder)
    kinds = F.array(*[F.lit(c) for c in _CATEGORIES])
    return posts.groupBy("thread_id").agg(
        F.min_by("content", "turn").alias("title"),
        F.array(
            F.concat(F.lit("tag"), (F.col("thread_id") % 9).cast("string")),
            F.when(F.count("*") > 6, "Long").otherwise("Short"),
        ).alias("tags"),
        F.element_at(kinds, (1 + F.col("thread_id") % 4).cast("int")).alias("category"),
        F.sum(F.length("content")).alias("views"),
        F.max("created_at").alias("last_activity"),
    )


@query(
    "J2",
    views="posts users",
    sql="SELECT post_id, p.user_id, coalesce(u.name, 'Unknown User') AS user_name FROM posts p LEFT JOIN (SELECT * FROM users WHERE user_id <> 999) u ON p.user_id = u.user_id",
)
def posts_with_users(spark, folder):
    posts = views.posts(spark, folder).select("post_id", "user_id")
    return forum.with_user_names(posts, views.users(spark, folder).filter("user_id <> 999"))


@query(
    "J3",
    views="posts",
    sql="""
SELECT thread_id, 0::BIGINT AS page, string_agg(post_id || ':' || user_id, ',' ORDER BY created_at, post_id) AS posts FROM posts GROUP BY thread_id
""",
)
def nested_posts(spark, folder):
    nested = forum.nested_posts(views.posts(spark, folder).select("thread_id", "post_id", "user_id", "created_at"))
    shown = F.transform("posts", lambda p: F.concat_ws(":", p["post_id"], p["user_id"]))
    return nested.withColumn("posts", F.array_join(shown, ","))


@query(
    "J4",
    views="posts",
    sql="SELECT a.post_id, a.parent_post_id, a.user_id, b.user_id AS parent_user_id FROM posts a LEFT JOIN posts b ON a.parent_post_id = b.post_id",
)
def replies_with_parents(spark, folder):
    return forum.with_parents(views.posts(spark, folder).select("post_id", "parent_post_id", "user_id"))


@query(
    "A14",
    views="posts",
    sql="""
SELECT thread_id, count(*) - 1 AS replies, count(DISTINCT user_id) AS participants, min(created_at) AS created_at, max(created_at) AS last_activity,
  sum(length(content))::BIGINT AS views FROM posts GROUP BY thread_id
""",
)
def thread_statistics(spark, folder):
    return forum.thread_statistics(views.posts(spark, folder))


@query(
    "A14",
    views="posts",
    sql="""
SELECT user_id, count(*) AS posts_count, count(*) FILTER (role = 'assistant' AND turn % 4 = 1) AS helpful_answers,
  count(*) FILTER (role = 'assistant' AND turn % 4 = 1) * 10 AS reputation FROM posts GROUP BY user_id
""",
)
def user_statistics(spark, folder):
    solution = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    return forum.user_statistics(views.posts(spark, folder), solution)


@query("T1", sql=f"WITH {_THREADS_SQL} SELECT thread_id, title, views FROM threads ORDER BY views DESC, thread_id LIMIT 10")
def popular_threads(spark, folder):
    return forum.popular(_threads(spark, folder).select("thread_id", "title", "views"), 10)


@query(
    "T2",
    sql=f"WITH {_THREADS_SQL} SELECT thread_id, title, last_activity FROM threads ORDER BY last_activity DESC, thread_id LIMIT 10",
)
def recent_threads(spark, folder):
    return forum.recent(_threads(spark, folder).select("thread_id", "title", "last_activity"), 10)


@query(
    "P32",
    sql=f"WITH {_THREADS_SQL} SELECT thread_id, category, views FROM threads WHERE category = 'Investing & Trading'",
)
def threads_by_category(spark, folder):
    return forum.in_category(_threads(spark, folder), "Investing & Trading").select("thread_id", "category", "views")


@query("P32", views="posts", sql="SELECT post_id, thread_id, user_id, content FROM posts WHERE post_id = 3001")
def post_by_id(spark, folder):
    return views.posts(spark, folder).filter("post_id = 3001").select("post_id", "thread_id", "user_id", "content")


@query(
    "P33",
    sql=f"""
WITH {_THREADS_SQL} SELECT thread_id, title FROM threads WHERE contains(lower(title), 'long') OR len(list_filter(tags, lambda t: contains(lower(t), 'long'))) > 0
""",
)
def thread_search(spark, folder):
    return forum.search(_threads(spark, folder), "LONG").select("thread_id", "title")


@query(
    "P30",
    sql=f"""
WITH {_THREADS_SQL}, s AS (SELECT thread_id, CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(last_activity) AS BIGINT) AS s FROM threads)
SELECT thread_id, CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ago' WHEN s % 86400 > 3600 THEN (s % 86400) // 3600 || 'h ago' ELSE (s % 86400) // 60 || 'm ago' END AS age
FROM s WHERE s >= 0
""",
)
def thread_ages(spark, folder):
    as_of = F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
    threads = _threads(spark, folder).filter(F.col("last_activity") <= as_of)
    return threads.select("thread_id", age_label(F.col("last_activity"), as_of).alias("age"))


_VOTES_SQL = """
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, post_id ORDER BY ts DESC, id DESC) AS r,
  first_value(vote) OVER (PARTITION BY user_id, post_id ORDER BY ts DESC, id DESC) AS last FROM votes),
run AS (SELECT user_id, post_id, any_value(last) AS vote, coalesce(min(r) FILTER (vote <> last) - 1, count(*)) AS n FROM o GROUP BY 1, 2),
standing AS (SELECT user_id, post_id, vote FROM run WHERE n % 2 = 1)
"""


@query("W16", views="votes", sql=f"WITH {_VOTES_SQL} SELECT * FROM standing")
def vote_states(spark, folder):
    return forum.vote_states(views.votes(spark, folder))


@query(
    "W16 A14",
    views="votes",
    sql=f"WITH {_VOTES_SQL} SELECT post_id, count(*) FILTER (vote = 'upvote') AS upvotes, count(*) FILTER (vote = 'downvote') AS downvotes FROM standing GROUP BY 1",
)
def post_votes(spark, folder):
    return forum.post_votes(views.votes(spark, folder))


# -- learning --------------------------------------------------------------------

_PROGRESS_SQL = """
l AS (SELECT user_id, course_id, lesson, sum(minutes) AS minutes, arg_max(score, ts) AS score, max(ts) AS ts FROM lessons_done GROUP BY 1, 2, 3),
t AS (SELECT event_type AS course_id, CASE WHEN event_type IN ('click', 'view') THEN 8 ELSE 5 END AS total_lessons FROM (SELECT DISTINCT event_type FROM events)),
p AS (SELECT user_id, l.course_id, count(*) AS lessons_completed, sum(minutes) AS minutes, avg(score) AS average_score, max(ts) AS last_accessed,
  any_value(total_lessons) AS total_lessons, count(*) * 100 / any_value(total_lessons)::DOUBLE AS completion FROM l JOIN t ON l.course_id = t.course_id GROUP BY 1, 2)
"""


def _progress(spark, folder):
    lessons = (
        table(spark, folder, "events")
        .select(F.col("event_type").alias("course_id"))
        .distinct()
        .withColumn("total_lessons", F.when(F.col("course_id").isin("click", "view"), 8).otherwise(5))
    )
    return learning.course_progress(views.lessons_done(spark, folder), lessons)


@query(
    "A15",
    views="lessons_done",
    sql=f"""
WITH {_PROGRESS_SQL} SELECT user_id, course_id, lessons_completed, round(minutes, 2) AS minutes, round(average_score, 6) AS average_score, last_accessed,
  total_lessons, round(completion, 6) AS completion FROM p
""",
)
def course_progress(spark, folder):
    return rounded(_progress(spark, folder), "minutes").withColumn("minutes", F.round("minutes", 2))


@query(
    "A16",
    views="lessons_done",
    sql=f"""
WITH {_PROGRESS_SQL} SELECT user_id, count(*) AS courses, count(*) FILTER (completion >= 100) AS completed, round(sum(minutes), 2) AS minutes,
  round(count(*) FILTER (completion >= 100) / count(*)::DOUBLE * 100, 6) AS completion_rate FROM p GROUP BY 1
""",
)
def learner_overview(spark, folder):
    out = learning.learner_overview(_progress(spark, folder))
    return rounded(out, "minutes").withColumn("minutes", F.round("minutes", 2))


@query(
    "A17 J12",
    views="lessons_done",
    sql="""
WITH k AS (SELECT DISTINCT course_id, lesson, CAST(lesson % 4 AS BIGINT) AS correct FROM lessons_done),
a AS (SELECT user_id, d.course_id, CASE WHEN score % 4 = correct THEN 1 ELSE 0 END AS ok FROM lessons_done d LEFT JOIN k ON d.course_id = k.course_id AND d.lesson = k.lesson)
SELECT user_id, course_id, sum(ok)::BIGINT AS right_answers, count(*) AS questions, round(sum(ok) / count(*)::DOUBLE * 100, 6) AS score,
  sum(ok) / count(*)::DOUBLE * 100 >= 70 AS passed FROM a GROUP BY 1, 2
""",
)
def quiz_results(spark, folder):
    done = views.lessons_done(spark, folder)
    answers = done.select("user_id", "course_id", "lesson", (F.col("score") % 4).alias("answer"))
    key = done.select("course_id", "lesson").distinct().withColumn("correct", F.col("lesson") % 4)
    return rounded(learning.quiz_results(answers, key, ["course_id", "lesson"], ["user_id", "course_id"]))


_LEVELS = ["Beginner", "Intermediate", "Advanced"]
_COURSES_SQL = f"""
courses AS (SELECT doc_id AS course_id, split_part(text, chr(10), 1) AS title, text AS description, ({_LEVELS!r})[1 + doc_id % 3] AS difficulty, source AS category FROM documents)
"""


def _courses(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("course_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (1 + F.col("doc_id") % 3).cast("int")).alias("difficulty"),
        F.col("source").alias("category"),
    )


@query(
    "P34",
    sql=f"""
WITH {_COURSES_SQL} SELECT course_id, title FROM courses WHERE difficulty = 'Intermediate'
  AND (contains(lower(title), 'market') OR contains(lower(description), 'market') OR contains(lower(title), 'pour') OR contains(lower(description), 'pour'))
""",
)
def recommended_courses(spark, folder):
    return learning.recommended(_courses(spark, folder), "Intermediate", ["Market", "Pour"]).select("course_id", "title")


@query(
    "P34",
    sql=f"WITH {_COURSES_SQL} SELECT course_id, title FROM courses WHERE difficulty = 'Advanced' AND category = 'src3'",
)
def course_catalogue(spark, folder):
    return learning.catalogue(_courses(spark, folder), "Advanced", "src3").select("course_id", "title")
