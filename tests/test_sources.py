"""Payload edges, files and stored tables: S1, S4, S5, S7, S10, S12-S17, S19, F11, F16."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.sources import payloads, store

AS_OF = datetime(2024, 2, 1)


def docs(spark, *items):
    return spark.createDataFrame([(json.dumps(i) if not isinstance(i, str) else i,) for i in items], "payload string")


def test_time_series_edges(spark):
    good = {"Time Series (Daily)": {"2024-01-03": {"1. open": "1", "2. high": "x", "3. low": "0.5", "4. close": "2", "5. volume": "7"}}}
    out = payloads.series_bars(docs(spark, good, {"Note": "limit"}, "not json")).collect()
    assert len(out) == 1
    assert (out[0]["open"], out[0]["high"], out[0]["volume"], out[0]["ts"]) == (1.0, None, 7.0, datetime(2024, 1, 3))


def test_quotes_and_company(spark):
    df = docs(spark, {"Global Quote": {"05. price": "12.5"}}, {"Global Quote": {}}, {})
    assert [r[0] for r in df.select(payloads.quote_price(F.col("payload"))).collect()] == [12.5, None, None]
    info = docs(spark, {"Name": "A", "Sector": "None", "Size": "", "Beta": None}).select(payloads.company_info(F.col("payload")))
    assert info.first()[0] == {"Name": "A"}


def test_coin_history_skips_incomplete_quotes(spark):
    usd = {"open": 1, "high": 2, "low": 0, "close": 1, "volume": 5, "market_cap": 9}
    quotes = [{"timestamp": "2024-01-01T00:00:00.000Z", "quote": {"USD": usd}}, {"quote": {"USD": usd}}, {"timestamp": "2024-01-01T01:00:00.000Z", "quote": {}}]
    out = payloads.coin_history(docs(spark, {"data": {"quotes": quotes}}, {"data": {"quotes": []}})).collect()
    assert len(out) == 1 and out[0]["market_cap"] == 9.0


def test_news_defaults(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    a = payloads.news_a(docs(spark, {"title": None, "description": "d", "publishedAt": "2024-01-01T05:00:00Z"}, {"title": "t", "content": "c", "source": {"name": "N"}, "publishedAt": "?"}), as_of)
    rows = a.collect()
    assert (rows[0]["title"], rows[0]["content"], rows[0]["source"]) == ("Untitled", "d", "Unknown")
    assert rows[0]["published_at"] == datetime(2024, 1, 1, 5) and rows[1]["published_at"] == AS_OF
    b = payloads.news_b(docs(spark, {"title": "x", "summary": "s", "time_published": "20240102T030405"}), as_of).first()
    assert b["published_at"] == datetime(2024, 1, 2, 3, 4, 5)
    assert set(a.columns) == set(payloads.news_b(docs(spark, {}), as_of).columns)


def test_collectibles(spark):
    full = {
        "token_id": "1", "name": "", "description": None, "asset_contract": {"address": "0x"}, "collection": {"name": "C"},
        "traits": [{"trait_type": "a", "value": "1"}, {"trait_type": "a", "value": "2"}], "last_sale": {"total_price": "2000000000000000000"},
    }
    rows = payloads.collectibles(docs(spark, {"assets": [full, {"token_id": "2", "name": "n"}]})).collect()
    assert (rows[0]["name"], rows[0]["last_sale"], rows[0]["traits"]) == ("#1", 2.0, {"a": "2"})
    assert (rows[1]["name"], rows[1]["last_sale"], rows[1]["traits"]) == ("n", 0.0, {})


def test_training_files(spark, scratch):
    with open(f"{scratch}/stocks.csv", "w") as f:
        f.write("date,open,high,low,close,volume,Name\n2024-01-02,1,2,0.5,1.5,100,AAA\n2024-01-03,,2,0.5,1.5,,AAA\n")
    df = store.read_training_file(spark, "stocks", f"{scratch}/stocks.csv")
    assert df.count() == 2 and dict(df.dtypes)["date"] == "date"
    with pytest.raises(ValueError, match="Volume"):
        store.required_columns(df, ["date", "Volume"])
    for layout in [*schemas.TRAINING_FILES.values(), *schemas.TABLES.values()]:
        assert spark.createDataFrame([], layout).count() == 0


def test_save_modes_and_names(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    path = f"{scratch}/t"
    store.save_table(df, path, "fail")
    with pytest.raises(Exception, match="exist"):
        store.save_table(df, path, "fail")
    store.save_table(df, path, "append")
    assert spark.read.parquet(path).count() == 2
    store.save_table(df, path, "replace")
    assert store.load_table(spark, path, "v = :v", {"v": "a' OR '1'='1"}).count() == 0
    assert store.load_table(spark, path, F.col("id") == 1).count() == 1
    assert store.csv_folder("x", "20240102_030405") == "x_20240102_030405.csv"
    assert store.csv_folder("x.csv", "20240102_030405") == "x.csv"


def test_prices_of_other_symbols_stay(spark, scratch):
    path = f"{scratch}/prices"
    raw = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 10)], "Date string, Open double, High double, Low double, Close double, Volume long")
    for symbol in ("A", "B", "A"):
        store.save_prices(store.normalise_prices(raw, symbol, "Date"), path)
    back = spark.read.parquet(path)
    assert sorted(r["symbol"] for r in back.collect()) == ["A", "B"]
    copies = store.snapshot(spark, {"prices": path}, f"{scratch}/backup", "1")
    assert spark.read.parquet(copies["prices"]).count() == 2
    assert store.size_megabytes(spark, path) > 0


def test_csv_keeps_quotes_separators_and_line_breaks(spark, scratch):
    rows = [("1.5", "Shop, \"A\"", "two\nlines, \"quoted\" \\ back", "food"), ("2", " padded ", "plain", "x")]
    df = spark.createDataFrame(rows, "amount string, merchant string, description string, category string")
    store.save_csv(df, f"{scratch}/e.csv")
    back = store.read_training_file(spark, "expenses", f"{scratch}/e.csv")
    assert sorted(tuple(r) for r in back.select("amount", "merchant", "description", "category").collect()) == sorted(rows)
