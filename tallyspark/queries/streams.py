"""Queries that run a stream over the tables to its end and read what it wrote."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.ml import jobs
from tallyspark.operators import folds, security
from tallyspark.plans.lineage import fresh_dir
from tallyspark.queries.registry import query
from tallyspark.queries.security import LIMIT_SQL, LOCKOUT_SQL, RISK_SQL, request_sql
from tallyspark.sources import views
from tallyspark.sources.payloads import message_id
from tallyspark.sources.tables import table
from tallyspark.streaming import ingest, state, windows


def _events(spark, folder):
    return ingest.file_stream(spark, folder, "events.parquet", table(spark, folder, "events").schema)


def _finished(spark, stream, name):
    """Writes an append-mode stream to files until its input ends, then reads them."""
    path = fresh_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def _local(df):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"})


@query(
    "R12 S18 S24",
    sql="""
WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*) AS volume FROM events, w GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= mark
""",
)
def streamed_bars(spark, folder):
    """Hourly bars whose window the watermark has closed."""
    ticks = _events(spark, folder).select(F.col("event_type").alias("symbol"), "ts", "value")
    return _local(_finished(spark, windows.streamed_bars(ticks, "1 hour"), "bars"))


@query(
    "R12",
    sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ended_at, count(*) AS events FROM n GROUP BY user_id, k)
SELECT * FROM x WHERE ended_at <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""",
)
def streamed_sessions(spark, folder):
    """Closed activity sessions with a gap of six hours."""
    stream = windows.sessions(_events(spark, folder).select("user_id", "ts"), "user_id", "6 hours")
    return _local(_finished(spark, stream, "sessions"))


@query(
    "R3",
    sql="""
WITH c AS (SELECT event_type, ts FROM events WHERE value > 20), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM c),
w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL '48 minutes', ts) - INTERVAL 192 MINUTE, time_bucket(INTERVAL '48 minutes', ts), INTERVAL 48 MINUTE)) AS window_start FROM c),
g AS (SELECT event_type, window_start, count(*) AS anomaly_count FROM w GROUP BY 1, 2)
SELECT event_type, window_start, anomaly_count, CASE WHEN anomaly_count > 20 THEN 'high' ELSE 'medium' END AS severity FROM g, m
WHERE anomaly_count >= 10 AND window_start + INTERVAL 240 MINUTE <= mark
""",
)
def streamed_alerts(spark, folder):
    checks = _events(spark, folder).filter("value > 20").select("event_type", "ts")
    stream = windows.streamed_alerts(checks, "event_type", window="240 minutes", slide="48 minutes")
    return _local(_finished(spark, stream, "alerts"))


@query(
    "S27 R12",
    sql="""
WITH p AS (SELECT event_type || ':' || user_id || ':' || CAST(floor(epoch(ts) / 3600) AS BIGINT) AS payload, ts FROM events)
SELECT payload, substr(sha256(payload), 1, 16) AS message_id FROM p GROUP BY payload
""",
)
def streamed_messages(spark, folder):
    """One message per kind, user and hour; repeats come within the watermark."""
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("string")
    messages = _events(spark, folder).select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string"), hour).alias("payload"), "ts"
    )
    stream = ingest.deduplicated(messages, "payload", "ts", "2 hours")
    return _finished(spark, stream, "messages").select("payload", "message_id")


@query(
    "S27",
    sql="SELECT event_id, substr(sha256(props), 1, 16) AS message_id FROM events",
)
def message_ids(spark, folder):
    return table(spark, folder, "events").select("event_id", message_id(F.col("props")).alias("message_id"))


_SECRET = b"shared secret of the tests"


def _blob(mask):
    return "".join(f"\\x{b ^ mask:02X}" for b in _SECRET.ljust(64, b"\0"))


@query(
    "S28",
    sql=f"""
SELECT event_id, props, sha256('{_blob(0x5C)}'::BLOB || unhex(sha256('{_blob(0x36)}'::BLOB || encode(props)))) AS signature, event_id % 10 > 1 AS accepted FROM events
""",
)
def signed_messages(spark, folder):
    """A tenth of the signatures is wrong and a tenth missing; those rows are quarantined."""
    rows = table(spark, folder, "events").select(
        "event_id", "props", ingest.signature(F.col("props"), _SECRET).alias("signature")
    )
    given = F.when(F.col("event_id") % 10 == 0, F.lit("sha256=00")).when(
        F.col("event_id") % 10 != 1, F.concat(F.lit("sha256="), "signature")
    )
    good, bad = ingest.split_signed(rows.withColumn("given", given), "props", "given", _SECRET)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.drop("given")


def _batches(spark, stream, work, name):
    path = fresh_dir(spark, name)
    ingest.start_batches(stream, work(f"{path}/data"), f"{path}/log", every=None).awaitTermination()
    return f"{path}/data"


@query(
    "R1 X2 S24 S25",
    sql="""
SELECT event_id, user_id, round(value * 1.1, 6) AS value, strftime(ts, '%Y-%m-%d-%H') AS hour FROM events
""",
)
def streamed_batches(spark, folder):
    """A user function on each micro-batch, written by hour."""

    def work(path):
        write = ingest.hourly(path, "ts")

        def run(batch, batch_id):
            write(batch.select("event_id", "user_id", F.round(F.col("value") * 1.1, 6).alias("value"), "ts"), batch_id)

        return run

    path = _batches(spark, _events(spark, folder), work, "batches")
    out = spark.read.parquet(f"{path}/batch=*")
    return out.select("event_id", "user_id", "value", "hour")


@query(
    "S26",
    sql="""
WITH e AS (SELECT CASE event_type WHEN 'purchase' THEN 'financial_data' WHEN 'view' THEN 'market_data' WHEN 'error' THEN 'alerts' ELSE 'other' END AS type,
  event_type, user_id, ts, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'medium' END AS priority FROM events)
SELECT 'financial_data' AS route, CAST(user_id AS VARCHAR) AS name, max(ts) AS newest, 1::BIGINT AS n FROM e WHERE type = 'financial_data' GROUP BY user_id
UNION ALL SELECT 'market_data', 'all', max(ts), count(*) FROM e WHERE type = 'market_data'
UNION ALL SELECT 'alerts', priority, max(ts), count(*) FROM e WHERE type = 'alerts' GROUP BY priority
""",
)
def routed_events(spark, folder):
    """Events routed by type into three tables, then summarised."""
    kind = (
        F.when(F.col("event_type") == "purchase", "financial_data")
        .when(F.col("event_type") == "view", "market_data")
        .when(F.col("event_type") == "error", "alerts")
        .otherwise("other")
    )
    fields = F.struct(
        F.col("user_id").cast("string").alias("symbol"), F.when(F.col("value") > 50, "high").alias("priority")
    )
    events = _events(spark, folder).select(
        kind.alias("type"), F.to_json(fields).alias("payload"), F.col("ts").alias("timestamp")
    )
    path = _batches(spark, events, ingest.route_events, "routes")

    def read(name):
        return spark.read.parquet(f"{path}/{name}/batch=*")

    financial = read("financial_data").groupBy("symbol").agg(F.max("timestamp").alias("newest"))
    parts = [
        financial.select(
            F.lit("financial_data").alias("route"), F.col("symbol").alias("name"), "newest", F.lit(1).cast("long").alias("n")
        ),
        read("market_data").agg(F.max("timestamp").alias("newest"), F.count("*").alias("n")).select(
            F.lit("market_data").alias("route"), F.lit("all").alias("name"), "newest", "n"
        ),
        read("alerts").groupBy("priority").agg(F.max("timestamp").alias("newest"), F.count("*").alias("n")).select(
            F.lit("alerts").alias("route"), F.col("priority").alias("name"), "newest", "n"
        ),
    ]
    return _local(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _logins(spark, folder):
    k = F.get_json_object("props", "$.k")
    return _events(spark, folder).select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).alias("user_id"),
        F.when(k.cast("long") < 80, "nat").otherwise(F.concat(F.lit("ip"), k)).alias("ip"),
        F.col("event_type").alias("agent"),
        (F.col("value") >= 60).alias("success"),
        "ts",
    )


@query("R7", views="logins", sql=LOCKOUT_SQL)
def streamed_lockouts(spark, folder):
    state.use_rocksdb(spark)
    stream = state.run_machine(_logins(spark, folder).select("user_id", "id", "ts", "success"), folds.LOCKOUT, "user_id")
    return _finished(spark, stream, "lockouts")


@query("R9", views="logins", sql=request_sql("HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM logins)"))
def streamed_requests_per_hour(spark, folder):
    """Requests of each address per hour that the watermark has closed."""
    requests = _logins(spark, folder).select(F.col("ip").alias("client"), "ts").withWatermark("ts", "10 minutes")
    return _local(_finished(spark, security.request_counts(requests), "requests"))


@query("R9", views="logins", sql=LIMIT_SQL)
def streamed_rate_limits(spark, folder):
    state.use_rocksdb(spark)
    requests = _logins(spark, folder).select(F.col("ip").alias("client"), "id", "ts")
    stream = state.run_machine(requests, folds.Limit(20, 25, 3600), "client", "string")
    return _finished(spark, stream, "limits")


@query("M15", views="v_features", sql="SELECT count(*) AS scored, 0::BIGINT AS mismatches, 1::BIGINT AS versions FROM v_features")
def streamed_model_scores(spark, folder):
    """A stream scored by the latest stored version of a vote, against the batch scores of that vote."""
    from tallyspark.queries.models import _small_vote

    rows, vote = _small_vote(spark, folder)
    path = fresh_dir(spark, "scored")
    jobs.save_version(vote, f"{path}/models")
    stream = ingest.file_stream(spark, folder, "embeddings.parquet", table(spark, folder, "embeddings").schema, ts=None)
    ready = stream.select(F.col("vec_id").alias("id"), *[F.element_at("embedding", i).cast("double").alias(f"V{i}") for i in range(1, views.V_COUNT + 1)])
    scores = jobs.scored_stream(ready, ["id"], f"{path}/models", f"{path}/scores", f"{path}/log")
    both = vote.transform(rows).select("id", F.element_at("probability", 2).alias("batch")).join(scores, "id", "full")
    wrong = F.coalesce(F.abs(F.element_at("probability", 2) - F.col("batch")) > 1e-12, F.lit(True))
    return both.agg(F.count("*").alias("scored"), F.count_if(wrong).alias("mismatches"), F.countDistinct("version").alias("versions"))


@query(
    "R2 X3",
    sql="""
WITH r AS (SELECT * FROM (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 100),
s AS (SELECT user_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM r GROUP BY 1)
SELECT r.user_id, max(ts) AS ts, count(*) AS total_points, count(*) FILTER (n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS anomaly_count
FROM r JOIN s ON r.user_id = s.user_id GROUP BY 1
""",
)
def streamed_monitor(spark, folder):
    state.use_rocksdb(spark)
    rows = _events(spark, folder).select("user_id", "ts", "value")
    return _local(_finished(spark, state.watch_values(rows, "user_id"), "monitor"))


@query(
    "R5",
    sql="""
WITH l AS (SELECT event_id AS id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 80 THEN 'nat' ELSE 'ip' || json_extract_string(props, '$.k') END AS ip, ts FROM events),
a AS (SELECT id, ip, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 300 SECOND THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY ip ORDER BY ts, id)),
b AS (SELECT id, ip, ts, sum(s) OVER (PARTITION BY ip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT id, row_number() OVER (PARTITION BY ip, k ORDER BY ts, id) AS attempt_count FROM b
""",
)
def streamed_attempt_counts(spark, folder):
    state.use_rocksdb(spark)
    return _finished(spark, state.attempt_counts(_logins(spark, folder)), "attempts")


@query(
    "X6 R4 X4 R1",
    sql="""
SELECT event_id, user_id, value, 'log' AS sink FROM events WHERE user_id = 7 UNION ALL SELECT event_id, user_id, value, 'alert' FROM events WHERE user_id = 7 AND value > 100
""",
)
def streamed_wallet_activity(spark, folder):
    """Events of one wallet, handed to two callbacks."""

    def work(path):
        def log(batch, batch_id):
            ingest.write_once(f"{path}/log")(batch.withColumn("sink", F.lit("log")), batch_id)

        def alert(batch, batch_id):
            large = batch.filter("value > 100").withColumn("sink", F.lit("alert"))
            ingest.write_once(f"{path}/alert")(large, batch_id)

        return ingest.fan_out(log, alert)

    stream = _events(spark, folder).filter("user_id = 7").select("event_id", "user_id", "value")
    path = _batches(spark, stream, work, "wallet")
    return spark.read.parquet(f"{path}/log/batch=*", f"{path}/alert/batch=*")


@query("R5", views="logins", sql=f"{RISK_SQL} SELECT id, user_id, risk FROM risk")
def streamed_login_risk(spark, folder):
    """Two streams in a row: attempt counts per address, then risk per user."""
    state.use_rocksdb(spark)
    counts = security.live_counter(
        views.logins(spark, folder), ["ip"], ["ts", "id"], security.ATTEMPT_LIFE, "attempt_count"
    ).select("id", "attempt_count")
    path = fresh_dir(spark, "counted")
    views.logins(spark, folder).join(counts, "id").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = ingest.file_stream(spark, path, "*.parquet", schema)
    return _finished(spark, state.login_risk(stream), "risk")


@query(
    "S25",
    sql=f"""
SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, count(*) AS n FROM events
WHERE date_trunc('hour', ts) >= date_trunc('hour', TIMESTAMP '{views.EVENTS_AS_OF}') - INTERVAL 240 HOUR GROUP BY 1
""",
)
def retained_hours(spark, folder):
    """Events stored by hour in two batches, after the retention job has dropped expired hours."""
    path = fresh_dir(spark, "hours")
    events = table(spark, folder, "events").select("event_id", "ts")
    write = ingest.hourly(path, "ts")
    write(events.filter("event_id % 2 = 0"), 0)
    write(events.filter("event_id % 2 = 1"), 1)
    ingest.drop_expired(spark, path, datetime.fromisoformat(views.EVENTS_AS_OF), 240)
    return spark.read.parquet(path).groupBy(F.col("hour").cast("string").alias("hour")).agg(F.count("*").alias("n"))
