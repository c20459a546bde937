"""Late rows, restart, duplicates, signatures, retention, keyed state."""

import hashlib
import hmac
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tallyspark.operators import security
from tallyspark.streaming import ingest, state, windows

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, value double"


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, path):
    q = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def test_restart_and_late_rows(spark, scratch):
    source = f"{scratch}/in"

    def bars():
        schema = spark.createDataFrame([], SCHEMA).schema
        stream = ingest.file_stream(spark, source, "*.parquet", schema)
        return windows.streamed_bars(stream, "5 minutes", "5 minutes")

    put(spark, source, [("a", T0 + timedelta(minutes=m), float(m)) for m in (0, 1, 4, 30)])
    drain(bars(), scratch)
    # A row older than the watermark is dropped; a new query goes on from the checkpoint.
    put(spark, source, [("a", T0 + timedelta(minutes=2), 99.0), ("a", T0 + timedelta(minutes=31), 5.0), ("a", T0 + timedelta(minutes=60), 1.0)])
    drain(bars(), scratch)
    out = {r["bar_start"]: (r["open"], r["high"], r["volume"]) for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert out == {T0: (0.0, 4.0, 3), T0 + timedelta(minutes=30): (30.0, 30.0, 2)}


def test_named_tables_are_files_or_folders(spark, scratch):
    """A table by its name is streamed whole, whether it is a folder of files or one file, and no other table with it."""
    import os
    import shutil

    df = spark.range(90).repartition(3)
    df.write.parquet(f"{scratch}/in/folder.parquet")
    df.filter("id < 30").coalesce(1).write.parquet(f"{scratch}/one")
    part = next(f for f in os.listdir(f"{scratch}/one") if f.endswith(".parquet"))
    shutil.copy(f"{scratch}/one/{part}", f"{scratch}/in/file.parquet")
    for name, rows in (("folder", 90), ("file", 30)):
        drain(ingest.file_stream(spark, f"{scratch}/in", f"{name}.parquet", df.schema, ts=None), f"{scratch}/{name}")
        found = spark.read.parquet(f"{scratch}/{name}/out")
        assert (found.count(), found.distinct().count()) == (rows, rows)


def test_duplicates_within_the_watermark(spark, scratch):
    put(spark, f"{scratch}/in", [("m1", T0, 0.0), ("m1", T0 + timedelta(minutes=5), 0.0), ("m2", T0, 0.0)])
    stream = ingest.file_stream(spark, f"{scratch}/in", "*.parquet", spark.createDataFrame([], SCHEMA).schema)
    drain(ingest.deduplicated(stream, "symbol", "ts"), scratch)
    got = spark.read.parquet(f"{scratch}/out").collect()
    assert sorted(r["message_id"] for r in got) == sorted(hashlib.sha256(m.encode()).hexdigest()[:16] for m in ("m1", "m2"))


def test_signatures(spark):
    for secret in (b"k", b"long" * 40):
        sign = lambda m: hmac.new(secret, m.encode(), hashlib.sha256).hexdigest()
        rows = [("é", sign("é")), ("b", "sha256=" + sign("b")), ("c", sign("x")), ("d", None)]
        df = spark.createDataFrame(rows, "payload string, given string")
        good, bad = ingest.split_signed(df, "payload", "given", secret)
        assert sorted(r["payload"] for r in good.collect()) == ["b", "é"]
        assert sorted(r["payload"] for r in bad.collect()) == ["c", "d"]


def test_batches_callbacks_and_retention(spark, scratch):
    put(spark, f"{scratch}/in", [("a", T0 + timedelta(hours=h), float(h)) for h in range(30)])
    stream = ingest.file_stream(spark, f"{scratch}/in", "*.parquet", spark.createDataFrame([], SCHEMA).schema)
    seen = []
    work = ingest.fan_out(ingest.hourly(f"{scratch}/out", "ts"), lambda b, i: seen.append(b.count()))
    ingest.start_batches(stream, work, f"{scratch}/log", every=None).awaitTermination()
    assert sum(seen) == 30
    rows = spark.read.parquet(f"{scratch}/out/batch=*")
    as_of = F.lit("2024-01-02 05:00:00").cast("timestamp")
    assert ingest.kept_hours(rows, as_of).count() == 25
    assert [r["value"] for r in ingest.newest(rows, "ts", "symbol", 2).collect()] == [29.0, 28.0]


def test_event_routes(spark):
    rows = [
        ("financial_data", '{"symbol":"A"}', T0), ("financial_data", '{"symbol":"A","p":2}', T0 + timedelta(seconds=9)),
        ("financial_data", "{}", T0), ("market_data", "{}", T0), ("alerts", '{"priority":"high"}', T0), ("alerts", "{}", T0), ("x", "{}", T0),
    ]
    events = spark.createDataFrame(rows, "type string, payload string, timestamp timestamp")
    latest = {r["symbol"]: r["payload"] for r in ingest.latest_financial(events).collect()}
    assert latest == {"A": '{"symbol":"A","p":2}', "unknown": "{}"}
    later = F.lit("2024-01-01 00:05:05").cast("timestamp")
    assert [r["symbol"] for r in ingest.latest_financial(events, later).collect()] == ["A"]
    assert ingest.market_rows(events, F.lit("2024-01-01 02:00:00").cast("timestamp")).count() == 0
    assert sorted(r["priority"] for r in ingest.alert_rows(events).collect()) == ["high", "medium"]


class Stored:
    """A value or a map of the state store that counts its look-ups."""

    def __init__(self):
        self.value, self.items, self.asked = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.items

    def updateValue(self, key, value):
        self.items[key] = value

    def clear(self):
        self.items.clear()


def test_streamed_risk_asks_for_an_item_once_a_batch():
    stored = {}

    class Handle:
        def getValueState(self, name, *schemas):
            return stored.setdefault(name, Stored())

        getMapState = getValueState

    risk = state.LoginRisk()
    risk.init(Handle())

    def batch(first, agents):
        n = 100
        return pd.DataFrame({"id": range(first, first + n), "ts": [T0 + timedelta(seconds=first + i) for i in range(n)], "success": [i % 2 == 1 for i in range(n)],
            "ip": "a", "agent": [agents[i % len(agents)] for i in range(n)], "attempt_count": 1})

    risks = next(risk.handleInputRows((1,), iter([batch(0, "xy")]), None))["risk"].tolist()
    # x only ever fails; a and y succeed in the second row.
    assert risks[:4] == [50, 50, 20, 0] and stored["ips"].asked == 1 and stored["agents"].asked == 2
    again = next(risk.handleInputRows((1,), iter([batch(100, "xyz")]), None))["risk"].tolist()
    assert again[1] == 0 and stored["ips"].asked == 2 and stored["agents"].asked == 5
    assert set(stored["agents"].items) == {("x",), ("y",), ("z",)}


def test_streamed_risk_forgets_after_thirty_days(spark, scratch):
    state.use_rocksdb(spark)
    days = [0, 1, 20, 49, 51, 52]
    rows = [(1, i, T0 + timedelta(days=d), True, "ip", "agent", 1) for i, d in enumerate(days)]
    schema = "user_id long, id long, ts timestamp, success boolean, ip string, agent string, attempt_count long"
    for part in (rows[:3], rows[3:]):
        put(spark, f"{scratch}/in", part, schema)
        stream = ingest.file_stream(spark, f"{scratch}/in", "*.parquet", spark.createDataFrame([], schema).schema)
        drain(state.login_risk(stream), scratch)
    got = {r["id"]: r["risk"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {0: 50, 1: 0, 2: 0, 3: 50, 4: 0, 5: 0}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r["id"]: r["risk"] for r in security.login_risk(batch.drop("attempt_count")).collect()} == got


def test_stream_scores_pick_up_new_versions(spark, scratch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from tallyspark.ml import ensembles, jobs

    schema = "id int, y double, a double, b double"
    rows = [(i, float(i % 2), float(i % 2) + i / 100, float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    prepare = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")])
    votes = [ensembles.SoftVote.fit(df, prepare, [ensembles.boosted_trees("y", "f", n, 2), ensembles.logistic("y", "f")]) for n in (1, 3)]
    stream = lambda: ingest.file_stream(spark, f"{scratch}/in", "*.parquet", df.schema, ts=None)
    run = lambda: jobs.scored_stream(stream(), ["id"], f"{scratch}/models", f"{scratch}/out", f"{scratch}/log")
    put(spark, f"{scratch}/in", rows[:15], schema)
    assert jobs.latest_version(spark, f"{scratch}/models") is None and jobs.save_version(votes[0], f"{scratch}/models") == 1
    assert {r.version for r in run().collect()} == {1}
    put(spark, f"{scratch}/in", rows[15:], schema)
    assert jobs.save_version(votes[1], f"{scratch}/models") == 2
    found = {r.id: r for r in run().collect()}
    assert len(found) == 40 and [found[i].version for i in (0, 14, 15, 39)] == [1, 1, 2, 2]
    for version, vote in enumerate(votes, 1):
        for r in vote.transform(df).collect():
            if found[r.id].version == version:
                assert abs(found[r.id].probability[1] - r.probability[1]) < 1e-12


def test_request_and_endpoint_windows(spark, scratch):
    calls = [("a", T0 + timedelta(minutes=m), m % 3 > 0) for m in range(30)] + [("b", T0 + timedelta(minutes=59, seconds=59), False), ("b", T0 + timedelta(minutes=60), True)]
    df = spark.createDataFrame(calls, "endpoint string, ts timestamp, success boolean")
    health = {(r.endpoint, r.window_start): (r.calls, r.failures, r.error_share) for r in security.endpoint_errors(df).collect()}
    assert health["a", T0] == (30, 10, 10 / 30) and health["a", T0 - timedelta(minutes=45)] == (15, 5, 5 / 15)
    assert health["b", T0] == (1, 1, 1.0) and health["b", T0 + timedelta(minutes=15)] == (2, 1, 0.5)
    counts = {(r.client, r.window_start): (r.requests, r.over_limit, r.over_burst) for r in security.request_counts(df.withColumnRenamed("endpoint", "client")).collect()}
    assert counts["a", T0] == (30, True, True) and counts["b", T0] == (1, False, False) == counts["b", T0 + timedelta(hours=1)]
