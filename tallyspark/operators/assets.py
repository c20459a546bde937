"""Token and collectible portfolios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div
from tallyspark.plans.keyed import KeyedRows, any_of

# Weights of the last sale and of the collection's floor price.
SALE_WEIGHT, FLOOR_WEIGHT = 0.6, 0.4


def estimated_value(last_sale: Column, floor: Column) -> Column:
    blended = last_sale * SALE_WEIGHT + floor * FLOOR_WEIGHT
    return F.greatest(F.when(last_sale > 0, blended).otherwise(floor), F.lit(0.0))


def with_values(assets: DataFrame, floors: DataFrame) -> DataFrame:
    """Floor price of the collection (0 if unknown) and the estimated value."""
    priced = KeyedRows(assets, ["collection"]).attach(floors).fillna(0.0, ["floor_price"])
    return priced.withColumn("estimated_value", estimated_value(F.col("last_sale"), F.col("floor_price")))


def portfolio_analytics(valued: DataFrame) -> DataFrame:
    """Count, total and average per owner, per collection and per network, in one pass."""
    by_group = valued.groupingSets(
        [["owner"], ["owner", "collection"], ["owner", "network"]], "owner", "collection", "network"
    )
    out = by_group.agg(
        F.grouping_id().alias("_grain"),
        F.count(F.lit(1)).alias("asset_count"),
        F.sum("estimated_value").alias("total_value"),
    )
    grain = F.when(F.col("_grain") == 3, "portfolio").when(F.col("_grain") == 1, "collection").otherwise("network")
    return out.select(
        "owner",
        grain.alias("grain"),
        F.coalesce("collection", "network").alias("name"),
        "asset_count",
        "total_value",
        safe_div(F.col("total_value"), F.col("asset_count")).alias("average_value"),
    )


def wallet_totals(valued: DataFrame, positions: DataFrame) -> DataFrame:
    """Per user: value of protocol positions, of collectibles, and both."""
    both = valued.select(
        F.col("owner").alias("user_id"), F.lit("nft").alias("kind"), F.col("estimated_value").alias("value")
    ).unionByName(positions.select("user_id", F.lit("defi").alias("kind"), "value"))

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0.0))

    return both.groupBy("user_id").agg(
        total("defi").alias("defi_value"),
        total("nft").alias("nft_value"),
        F.sum("value").alias("total_value"),
        F.count_if(F.col("kind") == "defi").alias("positions"),
    )


def consensus_price(quotes: DataFrame, keys: Sequence[str], source: str, price: str = "price") -> DataFrame:
    """Upper median over the quotes; missing and zero quotes do not count, 0 without any."""
    usable = quotes.filter(F.col(price) > 0).select(*keys, F.col(price).alias("_p"), source)
    rows = KeyedRows(usable, keys, ["_p", source])
    placed = rows.running({"_at": ("count", F.lit(1))})
    counts = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = rows.on(placed).attach(counts).filter(F.col("_at") == F.floor(F.col("_n") / 2) + 1)
    everyone = quotes.select(*keys).distinct()
    return everyone.join(middle.select(*keys, F.col("_p").alias("price")), keys, "left").fillna(0.0, ["price"])


def coin_ids(requests: DataFrame, coins: DataFrame) -> DataFrame:
    """Coin id by symbol or name, ignoring case; the first in catalogue order wins."""
    keys = coins.select(
        F.explode(F.array_distinct(F.array(F.lower("symbol"), F.lower("name")))).alias("_key"), "coin_id", "position"
    )
    first = keys.groupBy("_key").agg(F.min_by("coin_id", "position").alias("coin_id"))
    asked = requests.withColumn("_key", F.lower("text"))
    return KeyedRows(asked, ["_key"]).attach(first).drop("_key")


# Networks of each protocol with an integration.
PROTOCOL_NETWORKS = {
    "uniswap_v3": ["ethereum", "polygon"],
    "aave": ["ethereum", "polygon"],
    "pancakeswap": ["bsc"],
}

# Protocols listed for each network.
NETWORK_PROTOCOLS = {
    "ethereum": ["uniswap_v2", "uniswap_v3", "aave", "compound"],
    "bsc": ["pancakeswap"],
    "polygon": ["uniswap_v3", "aave"],
}


def supported_positions(rows: DataFrame, networks: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows whose protocol runs on their network, by a small fixed support list."""
    listed = networks or PROTOCOL_NETWORKS
    return rows.filter(
        any_of([(F.col("protocol") == p) & F.col("network").isin(n) for p, n in listed.items()])
    )


def support_matrix(spark: SparkSession, networks: dict[str, list[str]] | None = None) -> DataFrame:
    """(protocol, network) pairs as a table, one row per supported pair."""
    listed = networks or PROTOCOL_NETWORKS
    return spark.createDataFrame([(p, n) for p, ns in listed.items() for n in ns], "protocol string, network string")
