"""Login risk, unusual hours and sessions from event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.keyed import KeyedRows
from tallyspark.plans.lineage import cut

# Risk points and limits.
FAILED_POINTS, FAILED_LIMIT, FAILED_LIFE = 50, 5, 3600
ADDRESS_POINTS = 30
AGENT_POINTS = 20
ATTEMPT_POINTS, ATTEMPT_LIMIT, ATTEMPT_LIFE = 40, 10, 300
RISK_CAP = 100
KNOWN_LIFE = 30 * 86400
HOUR_DISTANCE, HOUR_HISTORY, HOUR_LIFE = 6, 168, 7 * 86400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _idle_sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: int) -> tuple[KeyedRows, DataFrame]:
    rows = KeyedRows(df.withColumn("_t", _micros(order[0])), keys, order)
    seen = rows.running({"_prev": ("last", F.col("_t"))}, exclusive=True)
    starts = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= seconds * 1_000_000)
    seen = seen.withColumn("_starts", starts)
    numbered = rows.on(seen).running(
        {"_session": ("sum", F.col("_starts").cast("int")), "_pos": ("count", F.lit(1))}
    )
    return rows, numbered.drop("_prev", "_t")


def idle_sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: int) -> DataFrame:
    """Adds ``_session``, which grows by one after ``seconds`` without a row, and ``_pos``."""
    return _idle_sessions(df, keys, order, seconds)[1].drop("_starts")


def live_counter(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: int, name: str) -> DataFrame:
    """Counter that each row renews and that restarts after ``seconds`` without one."""
    rows, numbered = _idle_sessions(df, keys, order, seconds)
    counted = rows.on(numbered).running({"_first": ("last", F.when(F.col("_starts"), F.col("_pos")))})
    return counted.withColumn(name, F.col("_pos") - F.col("_first") + 1).drop(
        "_session", "_pos", "_first", "_starts"
    )


def known_lives(successes: KeyedRows, user: str, item: str, life: int = KNOWN_LIFE) -> DataFrame:
    """Lives of each user's set of known items: (user, start, end) in microseconds.

    The set dies ``life`` seconds after its last addition, so a life ends at the first
    gap of that length between additions.  Each round settles one life per user; there
    are at most (time span / life) rounds, one for logs shorter than that.
    """
    life_us = life * 1_000_000
    slim = successes.df.select(user, item, _micros("ts").alias("t"))
    rows = successes.on(slim)
    starts = slim.groupBy(user).agg(F.min("t").alias("start"))
    done = None
    while True:
        current = rows.attach(starts).filter(F.col("t") >= F.col("start"))
        added = current.groupBy(user, item).agg(F.min("t").alias("t"), F.min("start").alias("start"))
        steps = KeyedRows(added, [user], ["t", item]).running({"_prev": ("last", F.col("t"))}, exclusive=True)
        gap = F.when(F.col("t") - F.col("_prev") >= life_us, F.col("_prev"))
        ends = steps.groupBy(user).agg(
            F.min("start").alias("start"), (F.coalesce(F.min(gap), F.max("t")) + life_us).alias("end")
        )
        ends = cut(ends)
        done = ends if done is None else done.unionByName(ends)
        later = rows.attach(ends.drop("start")).filter(F.col("t") >= F.col("end"))
        starts = later.groupBy(user).agg(F.min("t").alias("start"))
        if starts.isEmpty():
            return done
        starts = cut(starts)


def known_before(
    rows: KeyedRows, user: str, item: str, ok: Column, name: str, life: int = KNOWN_LIFE
) -> DataFrame:
    """Whether the user succeeded with the item earlier in the set's current life."""
    df = rows.df
    lives = known_lives(rows.on(df.filter(ok)), user, item, life)
    # A life lasts at least ``life``, so the list per user is bounded by the calendar.
    packed = lives.groupBy(user).agg(F.collect_list(F.struct("start", "end")).alias("_lives"))
    held = rows.attach(packed).withColumn("_t", _micros("ts"))
    inside = F.filter("_lives", lambda x: (F.col("_t") >= x["start"]) & (F.col("_t") < x["end"]))
    held = rows.on(held.withColumn("_life", F.get(inside, F.lit(0))["start"]).drop("_lives", "_t"))
    first = held.df.filter(ok).groupBy(user, "_life", item).agg(F.min(F.struct("ts", "id")).alias("_first"))
    marked = KeyedRows(held.df, [user, "_life", item]).attach(first)
    return marked.withColumn(name, F.coalesce(F.col("_first") < F.struct("ts", "id"), F.lit(False))).drop(
        "_first", "_life"
    )


def login_risk(logins: DataFrame) -> DataFrame:
    """Risk score of each attempt from failures, new address, new agent and rapid attempts."""
    failed = live_counter(
        logins.filter(~F.col("success")), ["user_id"], ["ts", "id"], FAILED_LIFE, "failed_count"
    ).select("id", "failed_count")
    attempts = live_counter(logins, ["ip"], ["ts", "id"], ATTEMPT_LIFE, "attempt_count")
    # Read six more times below.
    rows = KeyedRows(cut(attempts.join(failed, "id", "left")), ["user_id"])
    both = known_before(rows, "user_id", "ip", F.col("success"), "known_address")
    both = known_before(rows.on(both), "user_id", "agent", F.col("success"), "known_agent")
    points = (
        F.when(F.col("failed_count") > FAILED_LIMIT, FAILED_POINTS).otherwise(0)
        + F.when(F.col("known_address"), 0).otherwise(ADDRESS_POINTS)
        + F.when(F.col("known_agent"), 0).otherwise(AGENT_POINTS)
        + F.when(F.col("attempt_count") > ATTEMPT_LIMIT, ATTEMPT_POINTS).otherwise(0)
    )
    return both.withColumn("risk", F.least(points, F.lit(RISK_CAP)))


def unusual_hours(activity: DataFrame, key: str = "user_id") -> DataFrame:
    """Flags activity more than six hours from the mean hour of the last 168 activities."""
    sessions = idle_sessions(activity, [key], ["ts", "id"], HOUR_LIFE).withColumn("hour", F.hour("ts"))

    def build(w):
        mean = F.avg("hour").over(w.rowsBetween(-(HOUR_HISTORY - 1), 0))
        return {"mean_hour": mean, "unusual": F.abs(F.col("hour") - mean) > HOUR_DISTANCE}

    rows = KeyedRows(sessions, [key, "_session"], ["ts", "id"])
    return rows.rolling(HOUR_HISTORY - 1, 0, build).drop("_session", "_pos")


def active_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.filter((F.col("expires_at") > as_of) & (F.col("created_at") <= as_of))


def concurrent_sessions(sessions: DataFrame, key: str = "user_id", allowed: int = 3) -> DataFrame:
    """Highest number of sessions open at once per user, by a sweep of starts and ends."""
    edges = sessions.select(
        key, F.col("created_at").alias("at"), F.lit(1).alias("step"), F.col("id")
    ).unionByName(sessions.select(key, F.col("expires_at").alias("at"), F.lit(-1).alias("step"), F.col("id")))
    # Ends sort before starts of the same moment.
    open_now = KeyedRows(edges, [key], ["at", "step", "id"]).running({"open": ("sum", F.col("step"))})
    return open_now.groupBy(key).agg(F.max("open").alias("most_open")).withColumn(
        "over_limit", F.col("most_open") > allowed
    )


def audit_log(scored: DataFrame) -> DataFrame:
    """Audit rows of scored login attempts."""
    detail = F.to_json(F.struct("agent", "known_address", "known_agent"))
    return scored.select(
        "user_id",
        F.lit("login_attempt").alias("action"),
        "success",
        detail.alias("details"),
        F.col("ip").alias("ip_address"),
        F.col("ts").alias("at"),
        F.col("risk").alias("risk_score"),
    )


# -- requests and endpoints over windows -------------------------------------------------

# Requests per hour and in bursts of one address; window and step of endpoint error shares.
REQUESTS, BURST, REQUEST_WINDOW = 20, 25, "1 hour"
HEALTH_WINDOW, HEALTH_STEP = "1 hour", "15 minutes"


def request_counts(requests: DataFrame, client: str = "client", ts: str = "ts", window: str = REQUEST_WINDOW) -> DataFrame:
    """Requests per client and window, and whether they pass the limit and the burst; batch, or a stream with a watermark."""
    counted = requests.groupBy(client, F.window(ts, window).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(client, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > REQUESTS).alias("over_limit"), (F.col("requests") > BURST).alias("over_burst"))


def endpoint_errors(calls: DataFrame, endpoint: str = "endpoint", ts: str = "ts", window: str = HEALTH_WINDOW, step: str = HEALTH_STEP) -> DataFrame:
    """Calls, failures and their share per endpoint over sliding windows; batch, or a stream with a watermark."""
    counted = calls.groupBy(endpoint, F.window(ts, window, step).alias("w")).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"))
    return counted.select(endpoint, F.col("w.start").alias("window_start"), "calls", "failures", (F.col("failures") / F.col("calls")).alias("error_share"))
