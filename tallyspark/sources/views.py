"""Finance-shaped views over the shared tables.

``VIEWS`` builds each view as a DataFrame; ``VIEW_SQL`` states the same rows as SQL
for the result check.  Views are lazy, so a query reads only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.tables import spread, table

EVENTS_AS_OF = "2024-02-01 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

VIEW_SQL: dict[str, str] = {}
VIEWS = {}


def view(sql: str):
    def register(fn):
        VIEWS[fn.__name__] = fn
        VIEW_SQL[fn.__name__] = sql.strip()
        return fn

    return register


@view("""
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS date,
       CASE WHEN o_orderstatus = 'F' THEN 'Income' ELSE 'Expense' END AS type,
       o_orderpriority AS category,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount
FROM orders
""")
def transactions(spark: SparkSession, folder: str) -> DataFrame:
    income = F.col("o_orderstatus") == "F"
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("date"),
        F.when(income, "Income").otherwise("Expense").alias("type"),
        F.col("o_orderpriority").alias("category"),
        F.when(income, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"),
    )


@view("""
SELECT c_custkey AS user_id, c_name AS name, c_acctbal AS opening, c_mktsegment AS segment, c_nationkey AS nation_id
FROM customer
""")
def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("opening"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_id"),
    )


@view("""
SELECT event_id AS id, user_id AS key, ts, event_type AS kind,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value,
       value AS full_value,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS category,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events
""")
def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"),
        F.col("value").alias("full_value"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("category"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@view("""
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume
FROM events GROUP BY 1, 2
""")
def bars(spark: SparkSession, folder: str) -> DataFrame:
    ticks = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "value"
    )
    return ticks.groupBy("symbol", "hour").agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").alias("volume"),
    ).withColumnRenamed("hour", "ts")


@view("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / 100 AS amount,
       CAST(epoch(l_shipdate) - epoch(min(l_shipdate) OVER ()) AS BIGINT)
         + (l_orderkey * 7919 + l_linenumber * 3571 + l_partkey * 13) % 86400 AS time,
       CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END AS class
FROM lineitem
""")
def card_tx(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    start = lines.select(F.min(F.unix_seconds(F.col("l_shipdate").cast("timestamp")))).scalar()
    second = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 3571 + F.col("l_partkey") * 13) % 86400
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        (F.col("l_extendedprice") / 100).alias("amount"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - start + second).alias("time"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 1).otherwise(0).alias("class"),
    )


V_COUNT = 28


@view(
    "SELECT vec_id AS id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS class, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, V_COUNT + 1))
    + " FROM embeddings"
)
def v_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") == 3, 1).otherwise(0).alias("class"),
        *[F.element_at("embedding", i).cast("double").alias(f"V{i}") for i in range(1, V_COUNT + 1)],
    )


# The sixteen education levels of the census file.
EDUCATION = [
    "Preschool", "1st-4th", "5th-6th", "7th-8th", "9th", "10th", "11th", "12th",
    "HS-grad", "Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors", "Masters", "Prof-school", "Doctorate",
]


@view(
    f"""
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 17 = 0 THEN '?' ELSE CAST(15 + c_custkey % 90 AS VARCHAR) END AS age,
       CAST(c_custkey % 104 AS VARCHAR) AS hours_per_week,
       CASE WHEN c_custkey % 19 = 0 THEN '?' ELSE c_mktsegment END AS workclass,
       ({EDUCATION!r})[1 + c_custkey % 16] AS education,
       1 + c_custkey % 16 AS educational_num,
       CASE WHEN c_custkey % 11 = 0 THEN round(c_acctbal * 10) ELSE 0 END AS capital_gain,
       CASE WHEN c_custkey % 23 = 0 THEN round(c_acctbal) ELSE 0 END AS capital_loss,
       n_name AS native_country,
       c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def people(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        key.alias("id"),
        F.when(key % 17 == 0, "?").otherwise((15 + key % 90).cast("string")).alias("age"),
        (key % 104).cast("string").alias("hours_per_week"),
        F.when(key % 19 == 0, "?").otherwise(F.col("c_mktsegment")).alias("workclass"),
        F.element_at(F.array(*[F.lit(e) for e in EDUCATION]), (1 + key % 16).cast("int")).alias("education"),
        (1 + key % 16).alias("educational_num"),
        F.when(key % 11 == 0, F.round(F.col("c_acctbal") * 10)).otherwise(0.0).alias("capital_gain"),
        F.when(key % 23 == 0, F.round("c_acctbal")).otherwise(0.0).alias("capital_loss"),
        F.col("n_name").alias("native_country"),
        F.col("c_acctbal").alias("balance"),
    )


@view("""
SELECT doc_id AS id,
       CASE WHEN doc_id % 17 = 0 THEN 'n/a' WHEN doc_id % 5 = 0 THEN '$' || CAST(o_totalprice / 1000 AS VARCHAR)
            ELSE CAST(o_totalprice / 1000 AS VARCHAR) END AS amount_text,
       CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'Shop #' || CAST(doc_id % 50 AS VARCHAR) || ' (' || lang || ')' END AS merchant,
       text AS description, o_orderpriority AS category, o_orderdate AS date
FROM documents JOIN orders ON doc_id = o_orderkey
""")
def expenses(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    amount = (F.col("o_totalprice") / 1000).cast("string")
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    joined = docs.join(table(spark, folder, "orders"), key == F.col("o_orderkey"))
    return joined.select(
        key.alias("id"),
        F.when(key % 17 == 0, "n/a")
        .when(key % 5 == 0, F.concat(F.lit("$"), amount))
        .otherwise(amount)
        .alias("amount_text"),
        F.when(
            key % 29 != 0, F.concat(F.lit("Shop #"), (key % 50).cast("string"), F.lit(" ("), F.col("lang"), F.lit(")"))
        ).alias("merchant"),
        F.col("text").alias("description"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderdate").alias("date"),
    )


@view(f"""
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description, text AS content, source,
       TIMESTAMP '{EVENTS_AS_OF}' - to_minutes(CAST(doc_id * 3 AS BIGINT)) AS published_at
FROM documents
""")
def articles(spark: SparkSession, folder: str) -> DataFrame:
    back = F.make_dt_interval(mins=(F.col("doc_id") * 3).cast("int"))
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source")).select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"),
        F.col("text").alias("content"),
        "source",
        (F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - back).alias("published_at"),
    )


@view(f"""
SELECT conv_id AS thread_id, conv_id * 1000 + turn AS post_id,
       CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_post_id,
       CASE WHEN role = 'user' THEN conv_id % 40 WHEN role = 'assistant' THEN 100 + conv_id % 7 ELSE 999 END AS user_id,
       role, text AS content, turn,
       TIMESTAMP '{EVENTS_AS_OF}' - to_minutes(CAST(conv_id * 60 - turn * 7 AS BIGINT)) AS created_at
FROM conversations
""")
def posts(spark: SparkSession, folder: str) -> DataFrame:
    back = F.make_dt_interval(mins=(F.col("conv_id") * 60 - F.col("turn") * 7).cast("int"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("thread_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_post_id"),
        F.when(F.col("role") == "user", F.col("conv_id") % 40)
        .when(F.col("role") == "assistant", 100 + F.col("conv_id") % 7)
        .otherwise(999)
        .alias("user_id"),
        "role",
        F.col("text").alias("content"),
        "turn",
        (F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - back).alias("created_at"),
    )


@view("""
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS post_id,
       CASE WHEN event_type = 'click' THEN 'upvote' ELSE 'downvote' END AS vote, ts, event_id AS id
FROM events WHERE event_type IN ('click', 'error')
""")
def votes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("click", "error"))
        .select(
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("post_id"),
            F.when(F.col("event_type") == "click", "upvote").otherwise("downvote").alias("vote"),
            "ts",
            F.col("event_id").alias("id"),
        )
    )


@view("""
SELECT event_id AS id, user_id % 5 AS user_id,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 80 THEN 'nat'
            ELSE 'ip' || json_extract_string(props, '$.k') END AS ip,
       event_type AS agent, value >= 60 AS success, ts
FROM events
""")
def logins(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).alias("user_id"),
        F.when(k.cast("long") < 80, "nat").otherwise(F.concat(F.lit("ip"), k)).alias("ip"),
        F.col("event_type").alias("agent"),
        (F.col("value") >= 60).alias("success"),
        "ts",
    )


@view("""
SELECT user_id, event_type AS course_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS lesson,
       value AS minutes, CAST(floor(value) AS BIGINT) % 101 AS score, ts, event_id AS id
FROM events
""")
def lessons_done(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id",
        F.col("event_type").alias("course_id"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("lesson"),
        F.col("value").alias("minutes"),
        (F.floor("value") % 101).alias("score"),
        "ts",
        F.col("event_id").alias("id"),
    )


@view("""
SELECT l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS token_id, p_brand AS collection, p_type AS network,
       CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_extendedprice / 1000 END AS last_sale
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def assets(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        F.col("l_suppkey").alias("owner"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("token_id"),
        F.col("p_brand").alias("collection"),
        F.col("p_type").alias("network"),
        F.when(F.col("l_linenumber") % 4 == 0, 0.0).otherwise(F.col("l_extendedprice") / 1000).alias("last_sale"),
    )


@view("""
SELECT p_brand AS collection, min(p_retailprice) / 100 AS floor_price FROM part
WHERE p_brand <> 'Brand#7' GROUP BY p_brand
""")
def floors(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "part")
        .filter(F.col("p_brand") != "Brand#7")
        .groupBy(F.col("p_brand").alias("collection"))
        .agg((F.min("p_retailprice") / 100).alias("floor_price"))
    )


@view("""
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS user_id, l_partkey AS symbol, l_quantity AS shares,
       l_extendedprice / l_quantity AS purchase_price, p_retailprice AS current_price, l_shipdate AS purchase_date
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def holdings(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("symbol"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("purchase_price"),
        F.col("p_retailprice").alias("current_price"),
        F.col("l_shipdate").alias("purchase_date"),
    )
