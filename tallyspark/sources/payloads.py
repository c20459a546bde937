"""JSON payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import parse_time

# Field names of the payloads.
SERIES_FIELDS = ["open", "high", "low", "close", "volume"]
SERIES_NAMES = ["Time Series (Daily)", "Time Series (60min)"]
NEWS_B_SOURCE = "Alpha Vantage"
UNTITLED, UNKNOWN_SOURCE = "Untitled", "Unknown"


def series_bars(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Time-series JSON (date -> five fields by position) to typed bars; bad numbers are null."""
    keep = [c for c in df.columns if c != payload]
    parsed = F.from_json(F.col(payload), "map<string, map<string, map<string, string>>>")
    days = F.coalesce(*[F.element_at(parsed, n) for n in SERIES_NAMES])
    # Outer generators throughout: Spark would otherwise parse twice to test for empty lists.
    rows = df.select(*keep, F.explode_outer(days).alias("_day", "_fields")).filter(F.col("_day").isNotNull())
    values = F.transform(F.array_sort(F.map_entries("_fields")), lambda e: e["value"])
    typed = [F.get(values, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(SERIES_FIELDS)]
    return rows.select(*keep, F.col("_day").try_cast("timestamp_ntz").alias("ts"), *typed)


def quote_price(payload: Column) -> Column:
    """Latest stock price of a quote, null if missing."""
    parsed = F.from_json(payload, "map<string, map<string, string>>")
    return F.element_at(F.element_at(parsed, "Global Quote"), "05. price").try_cast("double")


def coin_price(payload: Column, coin_id: Column) -> Column:
    """Latest USD price of a coin in a quotes payload, null if missing."""
    shape = "data map<string, struct<quote: map<string, struct<price: double>>>>"
    data = F.from_json(payload, shape)["data"]
    return F.element_at(F.element_at(data, coin_id.cast("string"))["quote"], "USD")["price"]


def company_info(payload: Column) -> Column:
    """Company fields without empty and ``None`` values."""
    parsed = F.from_json(payload, "map<string, string>")
    return F.map_filter(parsed, lambda k, v: v.isNotNull() & ~v.isin("", "None"))


_COIN_BAR = "struct<open: double, high: double, low: double, close: double, volume: double, market_cap: double>"


def coin_history(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Quotes of a coin to rows; entries without a time or a USD quote are skipped."""
    keep = [c for c in df.columns if c != payload]
    shape = f"data struct<quotes: array<struct<timestamp: string, quote: map<string, {_COIN_BAR}>>>>"
    quotes = F.from_json(F.col(payload), shape)["data"]["quotes"]
    rows = df.select(*keep, F.inline_outer(quotes))
    usd = F.element_at("quote", "USD")
    return (
        rows.withColumn("_usd", usd)
        .filter(F.col("timestamp").isNotNull() & F.col("_usd").isNotNull())
        .select(*keep, F.col("timestamp").try_cast("timestamp").alias("ts"), "_usd.*")
    )


_LISTING_QUOTE = (
    "struct<price: double, volume_24h: double, market_cap: double, "
    "percent_change_1h: double, percent_change_24h: double, percent_change_7d: double>"
)


def coin_listing(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per listed coin with its USD quote."""
    shape = f"data array<struct<symbol: string, name: string, cmc_rank: long, quote: map<string, {_LISTING_QUOTE}>>>"
    rows = df.select(F.inline_outer(F.from_json(F.col(payload), shape)["data"])).filter(F.col("quote").isNotNull())
    return rows.select(
        "symbol", "name", F.col("cmc_rank").alias("rank"), F.element_at("quote", "USD").alias("_usd")
    ).select("symbol", "name", "rank", "_usd.*")


def top_coins(listing: DataFrame, size: int) -> DataFrame:
    return listing.orderBy(F.col("market_cap").desc_nulls_last(), F.col("symbol").asc()).limit(size)


def coin_map(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Catalogue rows with their position, for lookups by symbol or name."""
    shape = "data array<struct<id: long, symbol: string, name: string>>"
    entries = F.from_json(F.col(payload), shape)["data"]
    rows = df.select(F.posexplode_outer(entries).alias("position", "_c")).filter(F.col("_c").isNotNull())
    return rows.select(
        "position", F.col("_c.id").alias("coin_id"), "_c.symbol", "_c.name"
    )


def news_a(df: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Articles with nested source and ISO times."""
    keep = [c for c in df.columns if c != payload]
    shape = (
        "title string, description string, content string, url string, urlToImage string, "
        "publishedAt string, source struct<name: string>"
    )
    p = F.from_json(F.col(payload), shape)
    return df.select(
        *keep,
        F.coalesce(p["title"], F.lit(UNTITLED)).alias("title"),
        p["description"].alias("description"),
        F.coalesce(p["content"], p["description"]).alias("content"),
        p["url"].alias("url"),
        F.coalesce(p["source"]["name"], F.lit(UNKNOWN_SOURCE)).alias("source"),
        parse_time(p["publishedAt"], as_of).alias("published_at"),
        p["urlToImage"].alias("image_url"),
    )


def news_b(df: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Articles with a summary and compact times (20240115T093000)."""
    keep = [c for c in df.columns if c != payload]
    p = F.from_json(F.col(payload), "title string, summary string, url string, time_published string")
    compact = F.try_to_timestamp(p["time_published"], F.lit("yyyyMMdd'T'HHmmss"))
    return df.select(
        *keep,
        F.coalesce(p["title"], F.lit(UNTITLED)).alias("title"),
        p["summary"].alias("description"),
        p["summary"].alias("content"),
        p["url"].alias("url"),
        F.lit(NEWS_B_SOURCE).alias("source"),
        F.coalesce(compact, parse_time(p["time_published"], as_of)).alias("published_at"),
        F.lit(None).cast("string").alias("image_url"),
    )


def collectibles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """NFT JSON to rows: nested names, traits as a map, sale price in whole coins."""
    keep = [c for c in df.columns if c != payload]
    asset = (
        "struct<token_id: string, name: string, description: string, image_url: string, "
        "asset_contract: struct<address: string>, collection: struct<name: string>, "
        "traits: array<struct<trait_type: string, value: string>>, last_sale: struct<total_price: string>>"
    )
    listed = F.from_json(F.col(payload), f"assets array<{asset}>")["assets"]
    rows = df.select(*keep, F.inline_outer(listed)).filter(F.col("token_id").isNotNull())
    # Later traits of the same kind win, so the map is built from the last of each kind.
    kinds = F.array_distinct(F.transform("traits", lambda t: t["trait_type"]))
    pairs = F.transform(
        kinds,
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter("traits", lambda t: t["trait_type"] == k), -1)["value"].alias("value"),
        ),
    )
    traits = F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))
    return rows.select(
        *keep,
        F.col("asset_contract.address").alias("contract"),
        "token_id",
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("#"), "token_id")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.col("collection.name").alias("collection"),
        traits.alias("traits"),
        (F.coalesce(F.col("last_sale.total_price").try_cast("double"), F.lit(0.0)) / 1e18).alias("last_sale"),
    )


def request_key(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def message_id(payload: Column) -> Column:
    """First sixteen hex digits of the payload's SHA-256."""
    return F.substring(F.sha2(payload, 256), 1, 16)
