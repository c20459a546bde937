"""Queries that turn table rows into JSON payloads and parse them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import parse_time
from tallyspark.queries.registry import query
from tallyspark.sources import payloads, views
from tallyspark.sources.tables import spread, table

_OHLCV = ["1. open", "2. high", "3. low", "4. close", "5. volume"]


@query("S12 T5", views="bars", sql="SELECT symbol, ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars")
def parsed_time_series(spark, folder):
    """Hourly bars written as one time-series document per symbol and day, then parsed."""
    bars = views.bars(spark, folder)
    fields = F.create_map(
        *[x for n, c in zip(_OHLCV, ["open", "high", "low", "close", "volume"]) for x in (F.lit(n), F.col(c).cast("string"))]
    )
    docs = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.to_json(
            F.create_map(
                F.lit("Time Series (60min)"),
                F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), fields))),
            )
        ).alias("payload")
    )
    return payloads.series_bars(docs.drop("day"))


@query(
    "S14",
    sql="SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS stock_price, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS coin_price FROM part",
)
def parsed_quotes(spark, folder):
    """Unparsable and missing prices become null."""
    price, key = F.col("p_retailprice"), F.col("p_partkey").cast("string")
    stock = F.to_json(
        F.create_map(
            F.lit("Global Quote"),
            F.create_map(F.lit("05. price"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(price.cast("string"))),
        )
    )
    entry = F.struct(F.struct(F.struct(price.alias("price")).alias("USD")).alias("quote"))
    coin_key = F.when(F.col("p_partkey") % 5 == 0, "0x").otherwise(key)
    coin = F.to_json(F.struct(F.create_map(coin_key, entry).alias("data")))
    rows = table(spark, folder, "part").select("p_partkey", stock.alias("s"), coin.alias("c"))
    return rows.select(
        "p_partkey",
        payloads.quote_price(F.col("s")).alias("stock_price"),
        payloads.coin_price(F.col("c"), F.col("p_partkey")).alias("coin_price"),
    )


@query(
    "S15",
    sql="""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'None' WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS sector, c_name AS name FROM customer)
SELECT c_custkey, CASE WHEN sector IN ('', 'None') THEN NULL ELSE sector END AS sector, name, CASE WHEN sector IN ('', 'None') THEN 1 ELSE 2 END AS fields FROM c
""",
)
def company_info(spark, folder):
    sector = (
        F.when(F.col("c_custkey") % 3 == 0, "None").when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_mktsegment"))
    )
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.to_json(F.struct(F.col("c_name").alias("Name"), sector.alias("Sector"))).alias("payload")
    )
    info = rows.select("c_custkey", payloads.company_info(F.col("payload")).alias("m"))
    return info.select(
        "c_custkey",
        F.col("m")["Sector"].alias("sector"),
        F.col("m")["Name"].alias("name"),
        F.size("m").alias("fields"),
    )


@query(
    "S16",
    views="bars",
    sql="SELECT symbol, ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume, close * 1000 AS market_cap FROM bars WHERE hour(ts) <> 3 AND hour(ts) <> 4",
)
def parsed_coin_history(spark, folder):
    """Quotes without a time (hour 3) or without a USD quote (hour 4) are skipped."""
    hour = F.hour("ts")
    usd = F.struct("open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), (F.col("close") * 1000).alias("market_cap"))
    quote = F.struct(
        F.when(hour != 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.create_map(F.when(hour == 4, "EUR").otherwise("USD"), usd).alias("quote"),
    )
    docs = views.bars(spark, folder).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(quote).alias("quotes")).alias("data"))).alias("payload")
    )
    out = payloads.coin_history(docs.drop("day"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "S17",
    sql="""
SELECT p_brand AS symbol, p_name || ' ' || p_partkey AS name, p_partkey AS rank, p_retailprice AS price, p_retailprice * p_size AS market_cap FROM part
ORDER BY market_cap DESC, symbol, name LIMIT 25
""",
)
def top_coins(spark, folder):
    entry = F.struct(
        F.col("p_brand").alias("symbol"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_partkey").alias("cmc_rank"),
        F.create_map(
            F.lit("USD"),
            F.struct(F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * F.col("p_size")).alias("market_cap")),
        ).alias("quote"),
    )
    docs = table(spark, folder, "part").select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("payload"))
    listing = payloads.coin_listing(docs)
    return payloads.top_coins(listing, 25).select("symbol", "name", "rank", "price", "market_cap")


@query(
    "F16",
    views="assets",
    sql="""
SELECT 'c' || collection AS contract, CAST(token_id AS VARCHAR) AS token_id, CASE WHEN token_id % 3 = 0 THEN '#' || token_id ELSE collection || '/' || token_id END AS name,
  collection, network AS background, round(last_sale, 6) AS last_sale FROM assets
""",
)
def parsed_collectibles(spark, folder):
    a = spread(views.assets(spark, folder))
    token = F.col("token_id").cast("string")
    asset = F.struct(
        token.alias("token_id"),
        F.when(F.col("token_id") % 3 != 0, F.concat_ws("/", "collection", token)).alias("name"),
        F.struct(F.concat(F.lit("c"), "collection").alias("address")).alias("asset_contract"),
        F.struct(F.col("collection").alias("name")).alias("collection"),
        F.array(F.struct(F.lit("background").alias("trait_type"), F.col("network").alias("value"))).alias("traits"),
        F.struct((F.col("last_sale") * 1e18).cast("decimal(38,0)").cast("string").alias("total_price")).alias("last_sale"),
    )
    docs = a.select(F.to_json(F.struct(F.array(asset).alias("assets"))).alias("payload"))
    out = payloads.collectibles(docs)
    return out.select(
        "contract", "token_id", "name", "collection", F.col("traits")["background"].alias("background"),
        F.round("last_sale", 6).alias("last_sale"),
    )


@query(
    "F17",
    sql="""
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS request_key FROM orders
""",
)
def request_keys(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", payloads.request_key(["o_orderstatus", "o_custkey"]).alias("request_key")
    )


@query(
    "F11",
    sql="""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) ELSE TIMESTAMP '2024-02-01' END AS at FROM events
""",
)
def parsed_times(spark, folder):
    """ISO with Z, plain date, epoch seconds and text that is no time at all."""
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 2, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
        .otherwise("soon")
    )
    default = F.lit("2024-02-01").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", parse_time(text, default).cast("timestamp_ntz").alias("at")
    )
