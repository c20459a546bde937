"""Stream sources, de-duplication, routing and sinks.

Event times must be timestamps with a zone for watermarks, so the readers cast them.
All sinks are idempotent per batch id: a batch that is run again replaces its own
output, which gives exactly-once files with a replayable source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyspark.sources.payloads import message_id

# Longest wait of the ingest loop.
BATCH_WAIT = "1 second"


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema: StructType, ts: str | None = "ts", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as a stream; a trigger takes all that is there unless bounded.

    A pattern without wildcards names a table, which is one file or a folder of files.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if any(c in pattern for c in "*?[{"):
        stream = reader.option("pathGlobFilter", pattern).parquet(folder)
    else:  # in braces, since a stream takes a single file only as a match
        stream = reader.parquet(f"{folder}/{{{pattern}}}")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, records: int | None = None) -> DataFrame:
    """JSON records of a topic as a stream; needs the Kafka connector on the class path.

    A trigger takes all new records unless ``records`` bounds it.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = (reader.option("maxOffsetsPerTrigger", records) if records else reader).load()
    return parsed(raw.select(F.col("value").cast("string").alias("payload"), "timestamp"), schema)


def parsed(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """JSON payload fields as columns next to the rest."""
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.from_json(F.col(payload), schema).alias("_r")).select(*keep, "_r.*")


def deduplicated(df: DataFrame, payload: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a message that arrive within the watermark."""
    return (
        df.withColumn("message_id", message_id(F.col(payload)))
        .withWatermark(ts, late)
        .dropDuplicatesWithinWatermark(["message_id"])
    )


def signature(payload: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of a text, from Spark's own hash (two nested SHA-256 over a padded key)."""
    block = 64
    key = hashlib.sha256(secret).digest() if len(secret) > block else secret
    key = key.ljust(block, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def signature_valid(payload: Column, given: Column, secret: bytes) -> Column:
    """Whether a signature (with or without ``sha256=``) fits the payload; a missing one does not."""
    plain = F.lower(F.regexp_replace(given, "^sha256=", ""))
    return F.coalesce(plain == signature(payload, secret), F.lit(False))


def split_signed(df: DataFrame, payload: str, given: str, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows."""
    checked = df.withColumn("_ok", signature_valid(F.col(payload), F.col(given), secret))
    return checked.filter("_ok").drop("_ok"), checked.filter(~F.col("_ok")).drop("_ok")


def start_batches(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = BATCH_WAIT
) -> StreamingQuery:
    """Runs ``work`` on each micro-batch; without ``every`` it stops at the end of the input."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def write_once(path: str, partition: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Batch writer that puts each batch into its own folder, replacing a failed try."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite")
        (out.partitionBy(*partition) if partition else out).parquet(f"{path}/batch={batch_id}")

    return write


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several writers (alert callbacks among them); the batch is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


# -- event routing ---------------------------------------------------------------

# Event types, their lives in seconds, and the default priority.
EVENT_LIVES = {"financial_data": 300, "market_data": 3600}
DEFAULT_PRIORITY = "medium"
UNKNOWN_SYMBOL = "unknown"


def latest_financial(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest financial payload per symbol, with its expiry; expired ones drop out with ``as_of``."""
    rows = events.filter(F.col("type") == "financial_data").select(
        F.coalesce(F.get_json_object("payload", "$.symbol"), F.lit(UNKNOWN_SYMBOL)).alias("symbol"), "payload", "timestamp"
    )
    newest = rows.groupBy("symbol").agg(
        F.max_by("payload", "timestamp").alias("payload"), F.max("timestamp").alias("timestamp")
    )
    life = F.make_dt_interval(secs=F.lit(float(EVENT_LIVES["financial_data"])))
    out = newest.withColumn("expires_at", F.col("timestamp") + life)
    return out if as_of is None else out.filter(F.col("expires_at") > as_of)


def market_rows(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    rows = events.filter(F.col("type") == "market_data").select("payload", "timestamp")
    if as_of is None:
        return rows
    life = F.make_dt_interval(secs=F.lit(float(EVENT_LIVES["market_data"])))
    return rows.filter(F.col("timestamp") + life > as_of)


def alert_rows(events: DataFrame) -> DataFrame:
    priority = F.coalesce(F.get_json_object("payload", "$.priority"), F.lit(DEFAULT_PRIORITY))
    return events.filter(F.col("type") == "alerts").select(priority.alias("priority"), "payload", "timestamp")


def route_events(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that splits events into three tables."""
    return fan_out(
        lambda b, i: write_once(f"{path}/financial_data")(latest_financial(b), i),
        lambda b, i: write_once(f"{path}/market_data")(market_rows(b), i),
        lambda b, i: write_once(f"{path}/alerts", ["priority"])(alert_rows(b), i),
    )


# -- retention ---------------------------------------------------------------------

# Results kept and their life.
KEPT_RESULTS, RESULT_HOURS = 10_001, 24


def hourly(path: str, ts: str) -> Callable[[DataFrame, int], None]:
    """Batch writer partitioned by the hour of ``ts``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Few files per hour; a very busy hour is split again by the adaptive planner.
        hours = batch.withColumn("hour", F.date_format(ts, "yyyy-MM-dd-HH")).hint("rebalance", "hour")
        write_once(path, ["hour"])(hours, batch_id)

    return write


def kept_hours(rows: DataFrame, as_of: Column, hours: int = RESULT_HOURS) -> DataFrame:
    """Rows whose hour is not older than the life; only their partitions are read."""
    oldest = F.date_format(as_of - F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd-HH")
    return rows.filter(F.col("hour") >= oldest)


def newest(rows: DataFrame, ts: str, tie: str, size: int = KEPT_RESULTS) -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(size)


def drop_expired(spark: SparkSession, path: str, as_of: datetime, hours: int = RESULT_HOURS) -> list[str]:
    """Deletes the hour partitions under the batch folders of ``hourly`` that are older than the life.

    Returns their names. Only folder names are listed; no data is read.
    """
    oldest = f"hour={as_of - timedelta(hours=hours):%Y-%m-%d-%H}"
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for batch in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/hour=*")):
        if batch.getPath().getName() < oldest:
            files.delete(batch.getPath(), True)
            gone.append(batch.getPath().getName())
    return sorted(gone)
