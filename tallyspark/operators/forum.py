"""Forum: threads, posts, votes and user statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.keyed import KeyedRows

SOLUTION_POINTS = 10
UNKNOWN_USER = "Unknown User"


def with_user_names(rows: DataFrame, users: DataFrame) -> DataFrame:
    """User names by id; missing users get a default."""
    names = users.select("user_id", F.col("name").alias("user_name"))
    return KeyedRows(rows, ["user_id"]).attach(names).fillna(UNKNOWN_USER, ["user_name"])


def with_parents(posts: DataFrame) -> DataFrame:
    """Each post with the author of the post it replies to."""
    parents = posts.select(F.col("post_id").alias("parent_post_id"), F.col("user_id").alias("parent_user_id"))
    # First posts have no parent; they skip the join, where their null keys would meet in one task.
    first = posts.filter(F.col("parent_post_id").isNull()).withColumn("parent_user_id", F.lit(None).cast(
        dict(posts.dtypes)["user_id"]
    ))
    replies = posts.filter(F.col("parent_post_id").isNotNull()).join(parents, "parent_post_id", "left")
    return replies.unionByName(first)


def nested_posts(posts: DataFrame, size: int | None = None) -> DataFrame:
    """One row per thread and page, with its posts in order.

    A page holds ``size`` posts, so one busy thread becomes many pages instead of one
    unbounded array.
    """
    size = size or 1000
    rows = KeyedRows(posts, ["thread_id"], ["created_at", "post_id"])
    placed = rows.running({"_at": ("count", F.lit(1))})
    page = F.floor((F.col("_at") - 1) / size)
    item = F.struct("created_at", "post_id", "user_id")
    return placed.groupBy("thread_id", page.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("posts"))


def thread_statistics(posts: DataFrame) -> DataFrame:
    """Replies, length, participants and last activity per thread."""
    return posts.groupBy("thread_id").agg(
        (F.count(F.lit(1)) - 1).alias("replies"),
        F.count_distinct("user_id").alias("participants"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_activity"),
        F.sum(F.length("content")).alias("views"),
    )


def user_statistics(posts: DataFrame, solution: Column) -> DataFrame:
    """Posts, helpful answers and reputation (ten points per solution) per user."""
    solved = F.count_if(solution)
    return posts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("posts_count"),
        solved.alias("helpful_answers"),
        (solved * SOLUTION_POINTS).alias("reputation"),
    )


def popular(threads: DataFrame, size: int) -> DataFrame:
    return threads.orderBy(F.col("views").desc(), F.col("thread_id").asc()).limit(size)


def recent(threads: DataFrame, size: int) -> DataFrame:
    return threads.orderBy(F.col("last_activity").desc(), F.col("thread_id").asc()).limit(size)


def in_category(threads: DataFrame, category: str) -> DataFrame:
    return threads.filter(F.col("category") == category)


def search(threads: DataFrame, query: str) -> DataFrame:
    """Threads with the query in the title or in a tag, ignoring case."""
    q = query.lower()
    return threads.filter(
        F.lower("title").contains(q) | F.exists("tags", lambda t: F.lower(t).contains(q))
    )


def vote_states(votes: DataFrame) -> DataFrame:
    """Final vote per (user, post): repeating a vote clears it, the other one replaces it.

    That equals the last kind, kept if its closing run has an odd length.  Runs are
    measured inside day pieces, which are then combined, so a user who keeps voting on
    one post is spread over many groups.
    """
    keys = ["user_id", "post_id"]
    piece = votes.withColumn("_piece", F.to_date("ts"))
    at = F.struct("ts", "id")
    newest = Window.partitionBy(*keys, "_piece").orderBy(F.col("ts").desc(), F.col("id").desc())
    marked = piece.withColumns(
        {"_r": F.row_number().over(newest), "_last": F.first("vote").over(newest)}
    )
    days = marked.groupBy(*keys, "_piece").agg(
        F.max_by("vote", at).alias("last"),
        F.count(F.lit(1)).alias("n"),
        (F.min(F.when(F.col("vote") != F.col("_last"), F.col("_r"))) - 1).alias("tail"),
    )
    # One row per key and day from here on.
    later = Window.partitionBy(*keys).orderBy(F.col("_piece").desc())
    days = days.withColumn("final", F.first("last").over(later))
    stops = F.col("tail").isNotNull() | (F.col("last") != F.col("final"))
    open_so_far = F.coalesce(
        F.max(stops.cast("int")).over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    share = (
        F.when(open_so_far == 1, 0)
        .when(F.col("last") != F.col("final"), 0)
        .otherwise(F.coalesce(F.col("tail"), F.col("n")))
    )
    runs = days.withColumn("share", share).groupBy(*keys).agg(
        F.max("final").alias("vote"), F.sum("share").alias("run")
    )
    return runs.filter(F.col("run") % 2 == 1).select(*keys, "vote")


def post_votes(votes: DataFrame) -> DataFrame:
    """Upvotes and downvotes standing on each post."""
    return vote_states(votes).groupBy("post_id").agg(
        F.count_if(F.col("vote") == "upvote").alias("upvotes"),
        F.count_if(F.col("vote") == "downvote").alias("downvotes"),
    )
