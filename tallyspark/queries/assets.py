"""Queries over token and collectible portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import assets as ops
from tallyspark.queries.bars import rounded
from tallyspark.queries.registry import query
from tallyspark.sources import views
from tallyspark.sources.tables import table

_VALUED_SQL = """
valued AS (SELECT a.*, coalesce(f.floor_price, 0) AS floor_price,
  greatest(CASE WHEN last_sale > 0 THEN last_sale * 0.6 + coalesce(f.floor_price, 0) * 0.4 ELSE coalesce(f.floor_price, 0) END, 0) AS estimated_value
  FROM assets a LEFT JOIN floors f ON a.collection = f.collection)
"""


def _valued(spark, folder):
    return ops.with_values(views.assets(spark, folder), views.floors(spark, folder))


@query(
    "J6 F15",
    views="assets floors",
    sql=f"WITH {_VALUED_SQL} SELECT owner, token_id, collection, network, round(floor_price, 6) AS floor_price, round(estimated_value, 6) AS estimated_value FROM valued",
)
def asset_values(spark, folder):
    return rounded(_valued(spark, folder).drop("last_sale"))


@query(
    "A2",
    views="assets floors",
    sql=f"""
WITH {_VALUED_SQL}
SELECT owner, CASE grouping(collection, network) WHEN 3 THEN 'portfolio' WHEN 1 THEN 'collection' ELSE 'network' END AS grain, coalesce(collection, network) AS name,
  count(*) AS asset_count, CAST(sum(CAST(round(estimated_value, 6) AS DECIMAL(18, 6))) AS DOUBLE) AS total_value,
  CAST(sum(CAST(round(estimated_value, 6) AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS average_value FROM valued
GROUP BY GROUPING SETS ((owner), (owner, collection), (owner, network))
""",
)
def portfolio_analytics(spark, folder):
    exact = F.round("estimated_value", 6).cast("decimal(18,6)")
    out = ops.portfolio_analytics(_valued(spark, folder).withColumn("estimated_value", exact))
    return out.withColumn("total_value", F.col("total_value").cast("double"))


@query(
    "A3 U1",
    views="assets floors",
    sql=f"""
WITH {_VALUED_SQL}, d AS (SELECT s_suppkey AS user_id, s_acctbal AS value FROM supplier),
u AS (SELECT owner AS user_id, 'nft' AS kind, estimated_value AS value FROM valued UNION ALL SELECT user_id, 'defi', value FROM d)
SELECT user_id, round(sum(CASE WHEN kind = 'defi' THEN value ELSE 0 END), 4) AS defi_value, round(sum(CASE WHEN kind = 'nft' THEN value ELSE 0 END), 4) AS nft_value,
  round(sum(value), 4) AS total_value, count(*) FILTER (kind = 'defi') AS positions FROM u GROUP BY 1
""",
)
def wallet_totals(spark, folder):
    positions = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_acctbal").alias("value")
    )
    out = ops.wallet_totals(_valued(spark, folder), positions)
    return out.withColumns({c: F.round(c, 4) for c in ("defi_value", "nft_value", "total_value")})


@query(
    "A4",
    sql="""
WITH q AS (SELECT l_partkey AS token, CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS price, l_orderkey * 10 + l_linenumber AS source, l_suppkey FROM lineitem),
r AS (SELECT token, price, row_number() OVER (PARTITION BY token ORDER BY price, source) - 1 AS i, count(*) OVER (PARTITION BY token) AS n FROM q WHERE price > 0)
SELECT t.token, coalesce(price, 0) AS price FROM (SELECT DISTINCT token FROM q) t LEFT JOIN (SELECT * FROM r WHERE i = n // 2) m ON t.token = m.token
""",
)
def consensus_prices(spark, folder):
    line = F.col("l_linenumber")
    quotes = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("token"),
        F.when(line == 7, 0.0).when(line != 6, F.col("l_extendedprice")).alias("price"),
        (F.col("l_orderkey") * 10 + line).alias("source"),
    )
    return ops.consensus_price(quotes, ["token"], "source")


@query(
    "J5",
    sql="""
WITH c AS (SELECT p_partkey AS coin_id, p_brand AS symbol, p_name AS name, p_partkey AS position FROM part),
k AS (SELECT lower(symbol) AS key, coin_id, position FROM c UNION ALL SELECT lower(name), coin_id, position FROM c),
f AS (SELECT key, arg_min(coin_id, position) AS coin_id FROM k GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN upper(p_name) WHEN l_linenumber % 3 = 1 THEN p_brand ELSE p_type END AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, text, coin_id FROM r LEFT JOIN f ON lower(text) = key
""",
)
def coin_lookup(spark, folder):
    part = table(spark, folder, "part")
    coins = part.select(
        F.col("p_partkey").alias("coin_id"),
        F.col("p_brand").alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("position"),
    )
    line = F.col("l_linenumber")
    requests = (
        table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            F.when(line % 3 == 0, F.upper("p_name"))
            .when(line % 3 == 1, F.col("p_brand"))
            .otherwise(F.col("p_type"))
            .alias("text"),
        )
    )
    return ops.coin_ids(requests, coins)


_NETWORKS = ["ethereum", "polygon", "bsc", "solana", "cardano"]
_PROTOCOLS = ["uniswap_v3", "aave", "pancakeswap", "curve"]


@query(
    "J7",
    sql=f"""
WITH p AS (SELECT l_suppkey AS user_id, l_orderkey, l_linenumber, l_partkey, ({_PROTOCOLS!r})[1 + l_partkey % 4] AS protocol, ({_NETWORKS!r})[1 + l_orderkey % 5] AS network FROM lineitem)
SELECT * FROM p WHERE (protocol IN ('uniswap_v3', 'aave') AND network IN ('ethereum', 'polygon')) OR (protocol = 'pancakeswap' AND network = 'bsc')
""",
)
def supported_positions(spark, folder):
    def choose(values, key):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col(key) % len(values)).cast("int"))

    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        choose(_PROTOCOLS, "l_partkey").alias("protocol"),
        choose(_NETWORKS, "l_orderkey").alias("network"),
    )
    return ops.supported_positions(rows)
