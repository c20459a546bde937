"""Queries that write tables to the shared folder and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.lineage import fresh_dir
from tallyspark.queries.registry import query
from tallyspark.sources import store, views
from tallyspark.sources.tables import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("S1 S4", views="expenses", sql="SELECT amount_text AS amount, merchant, description, category FROM expenses")
def expense_file_round_trip(spark, folder):
    """Saved as CSV with a header and read back with the fixed schema."""
    path = fresh_dir(spark, store.csv_folder("expenses", "20240201_000000"))
    rows = views.expenses(spark, folder).select(
        F.col("amount_text").alias("amount"), "merchant", "description", "category"
    )
    store.save_csv(rows, path)
    return store.read_training_file(spark, "expenses", path)


@query(
    "S5 S6",
    views="transactions",
    sql="""
SELECT id, user_id, strftime(date, '%Y-%m') AS year_month, amount FROM transactions
WHERE amount > 300000 AND strftime(date, '%Y-%m') = '1997-05'
""",
)
def saved_transactions(spark, folder):
    """Replaced, then appended to, then read with a predicate on the partition and bound values."""
    path = fresh_dir(spark, "transactions")
    rows = views.transactions(spark, folder).select(
        "id", "user_id", F.date_trunc("month", "date").alias("year_month"), "amount"
    )
    # Fewer files: rows of a month go together, busy months are split.
    store.save_table(rows.filter("id % 2 = 0").hint("rebalance", "year_month"), path, "replace", ["year_month"])
    store.save_table(rows.filter("id % 2 = 1").hint("rebalance", "year_month"), path, "append", ["year_month"])
    return store.load_table(
        spark, path, "amount > :least AND year_month = :month", {"least": 300000.0, "month": "1997-05"}
    )


@query(
    "S7 S9",
    views="bars",
    sql="""
WITH d AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS open_price, max(high) AS high_price, min(low) AS low_price, arg_max(close, ts) AS close_price, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2)
SELECT symbol, date, CASE WHEN symbol = 'view' THEN open_price + 1 ELSE open_price END AS open_price, high_price, low_price, close_price, volume FROM d
""",
)
def stored_prices(spark, folder):
    """All symbols are stored; a second save of one symbol leaves the others alone."""
    path = fresh_dir(spark, "prices")
    daily = (
        views.bars(spark, folder)
        .groupBy("symbol", F.to_date("ts").alias("date"))
        .agg(
            F.min_by("open", "ts").alias("Open"),
            F.max("high").alias("High"),
            F.min("low").alias("Low"),
            F.max_by("close", "ts").alias("Close"),
            F.sum("volume").alias("Volume"),
        )
    )
    prices = store.normalise_prices(daily)
    store.save_prices(prices, path)
    corrected = prices.filter("symbol = 'view'").withColumn("open_price", F.col("open_price") + 1)
    store.save_prices(corrected, path)
    return spark.read.parquet(path).select(
        "symbol", "date", "open_price", "high_price", "low_price", "close_price", "volume"
    )


@query(
    "S10 S11",
    sql=" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count, TRUE AS has_bytes FROM {t}" for t in TABLES),
)
def snapshot_sizes(spark, folder):
    """Row counts read from a snapshot of all tables, and whether their files have a size."""
    path = fresh_dir(spark, "backup")
    sources = {n: f"{folder}/{n}.parquet" for n in TABLES}
    copies = store.snapshot(spark, sources, path, "20240201_000000")
    parts = [
        spark.read.parquet(copy).agg(
            F.lit(name).alias("name"),
            F.count("*").alias("row_count"),
            F.lit(store.size_megabytes(spark, copy) > 0).alias("has_bytes"),
        )
        for name, copy in copies.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "S11",
    sql="SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def repeated_keys(spark, folder):
    """Order keys stand for transaction ids: those used more than once."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    return store.duplicates(rows, "transactions")
