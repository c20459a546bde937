"""Edge rows of single operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.exprs import age_label, cut
from tallyspark.operators import anomaly, assets, bars, cleaning, forum, fraud, ledger, people, security

T0 = datetime(2024, 1, 1)


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


# bins
def test_bin_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 4.99, 10.0, 10.01, 50.0, 99.99, 100.0, 300.0, 300.01, 2000.0)], "amount double")
    out = fraud.amount_features(df)
    assert values(out, "amount_category") == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert values(out, "high_risk_amount") == [1, 1, 0, 0, 0, 0, 1, 1, 0, 1]


def test_age_and_hour_bins(spark):
    df = spark.createDataFrame([(25, 20), (26, 40), (100, 100), (101, 101), (0, 0)], "a int, h int")
    out = df.select(
        cut(F.col("a"), people.AGE_EDGES, people.AGE_LABELS).alias("a"),
        cut(F.col("h"), people.HOUR_EDGES, people.HOUR_LABELS).alias("h"),
    )
    assert values(out, "a") == ["young", "early_career", "retirement", None, None]
    assert values(out, "h") == ["part_time", "full_time", "workaholic", None, None]


# P15
def test_card_times(spark):
    df = spark.createDataFrame([(22 * 3600,), (7 * 3600 - 1,), (7 * 3600,), (5 * 86400,)], "time long")
    out = fraud.time_features(df)
    assert values(out, "is_night") == [1, 1, 0, 1]
    assert values(out, "is_weekend") == [0, 0, 0, 1]


# P2, P4, P8, P9, P36
def test_column_steps(spark):
    df = spark.createDataFrame(
        [(1, None, " A ", "$1,000", "2024-01-02"), (2, None, "b", "5%", "bad"), (3, None, "c", "x", "2024-02-03")],
        "` Row Id` int, Gone string, `Label ` string, Price string, created string",
    )
    out = cleaning.normalise_names(cleaning.drop_empty_columns(df))
    assert out.columns == ["row_id", "label", "price", "created"]
    more = out.unionByName(out.withColumn("price", F.lit("7")))
    assert cleaning.detect_formats(more) == {"price": "number", "created": "date"}
    fixed = cleaning.standardise_formats(out, {"price": "number", "created": "date"}).orderBy("row_id")
    assert values(fixed, "price") == [1000.0, 5.0, None]
    assert values(fixed, "label") == ["a", "b", "c"]
    assert values(fixed, "created") == [datetime(2024, 1, 2), None, datetime(2024, 2, 3)]
    dates = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "x string")
    assert cleaning.detect_formats(dates) == {"x": "date"}
    late = spark.createDataFrame([(f"word{i}",) for i in range(200)] + [(str(i),) for i in range(900)], "x string")
    assert cleaning.detect_formats(late) == {"x": "number"}  # all values count, not the first ones
    kept = cleaning.drop_constant_columns(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), ["a", "b"])
    assert kept.columns == ["b"]


# Null is not zero, null times stay
def test_zero_and_time_rows(spark):
    df = spark.createDataFrame([(0, 0.0), (0, None), (0, 1.0)], "a int, b double")
    assert cleaning.drop_zero_rows(df).count() == 2
    times = spark.createDataFrame([(datetime(1899, 12, 31),), (None,), (T0,), (T0 + timedelta(days=2),)], "t timestamp_ntz")
    left = cleaning.drop_impossible_times(times, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    assert sorted(values(left, "t"), key=str) == [T0, None]


# Flat and rising prices; W14: short history
def series(spark, closes, symbol="a"):
    rows = [(symbol, T0 + timedelta(days=i), float(c), float(c), float(c), float(c), 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(
        rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    )


def test_indicator_edges(spark):
    rising = values(bars.rsi(series(spark, range(1, 10))).orderBy("ts"), "rsi_7")
    assert rising == [None] * 6 + [100.0] * 3
    flat = bars.rsi(series(spark, [5] * 25)).orderBy("ts")
    assert values(flat, "rsi_7") == [None] * 25
    bands = bars.indicators(series(spark, [5] * 25), bars.bollinger_columns, 19).orderBy("ts")
    assert values(bands, "bb_position") == [None] * 25
    both = series(spark, range(9), "nine").unionByName(series(spark, range(10), "ten"))
    assert bars.enough_history(both).select("symbol").distinct().collect()[0][0] == "ten"


# Zero divisors
def test_price_features_with_zero_open(spark):
    row = bars.price_features(series(spark, [0])).first()
    assert row["price_change_pct"] is None and row["high_low_pct"] is None


# W16
@pytest.mark.parametrize(
    "sequence, standing",
    [("uu", None), ("ud", "downvote"), ("uuu", "upvote"), ("u", "upvote"), ("udd", None), ("uddd", "downvote"), ("duu", None)],
)
def test_vote_sequences(spark, sequence, standing):
    kinds = {"u": "upvote", "d": "downvote"}
    # Votes twelve hours apart cross day pieces.
    rows = [(1, 1, kinds[c], T0 + timedelta(hours=12 * i), i) for i, c in enumerate(sequence)]
    df = spark.createDataFrame(rows, "user_id long, post_id long, vote string, ts timestamp_ntz, id long")
    got = forum.vote_states(df).collect()
    assert [r["vote"] for r in got] == ([standing] if standing else [])


def test_votes_equal_sequential_fold(spark):
    rng = np.random.default_rng(4)
    rows, state = [], {}
    for i in range(900):
        u, p, v = int(rng.integers(4)), int(rng.integers(5)), str(rng.choice(["upvote", "downvote"], p=[0.7, 0.3]))
        rows.append((u, p, v, T0 + timedelta(minutes=47 * i), i))
        if state.get((u, p)) == v:
            del state[u, p]
        else:
            state[u, p] = v
    df = spark.createDataFrame(rows, "user_id long, post_id long, vote string, ts timestamp_ntz, id long")
    got = {(r["user_id"], r["post_id"]): r["vote"] for r in forum.vote_states(df).collect()}
    assert got == state


# F1, F2, F6, F7, F3, F9, W15
def test_text_functions(spark):
    df = spark.createDataFrame(
        [("Café #12  Paris's", "Buy $TSLA and AAPL now, BRK.B THE end IBM", "a. b. c. d")], "m string, s string, t string"
    )
    row = df.select(
        text.clean_text(F.col("m")).alias("w"),
        text.clean_merchant(F.col("m")).alias("m"),
        text.symbols(F.col("s")).alias("s"),
        text.summary(F.col("t")).alias("t"),
        text.summary(F.repeat(F.lit("x"), 150)).alias("long"),
        text.title_key(F.lit("Hello, World!")).alias("k"),
        text.category(F.lit("Federal Reserve")).alias("c"),
        text.read_minutes(F.repeat(F.lit("w "), 450)).alias("r"),
    ).first()
    assert row["w"] == "café paris s" and row["m"] == "café 12 paris s"
    # "AAPL" stands before a space; "BRK" comes from the exchange notation.
    assert row["s"] == ["AAPL", "B", "BRK", "IBM", "TSLA"]
    assert row["t"] == "a. b. c."
    assert row["long"] == "x" * 100 + "..."
    assert row["k"] == "helloworld" and row["c"] == "central_banks" and row["r"] == 2


# P30
def test_age_labels(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    ages = [timedelta(days=2, hours=3), timedelta(hours=5), timedelta(hours=1), timedelta(minutes=12)]
    df = spark.createDataFrame([(datetime(2024, 1, 10) - a,) for a in ages], "t timestamp_ntz")
    assert values(df.select(age_label(F.col("t"), now).alias("x")), "x") == ["2d ago", "5h ago", "60m ago", "12m ago"]


# S8, A4, J5
def test_latest_consensus_and_lookup(spark):
    old = spark.createDataFrame([("a", 1.0, T0)], "symbol string, price double, updated_at timestamp_ntz")
    new = spark.createDataFrame([("a", 2.0, T0 + timedelta(1)), ("b", 3.0, T0)], old.schema)
    assert sorted(values(ledger.upsert_prices(old, new, ["symbol"], "updated_at"), "symbol", "price")) == [("a", 2.0), ("b", 3.0)]
    quotes = spark.createDataFrame(
        [("x", "s1", 1.0), ("x", "s2", 3.0), ("y", "s1", 0.0), ("y", "s2", None), ("z", "s1", 9.0)],
        "token string, source string, price double",
    )
    got = dict(values(assets.consensus_price(quotes, ["token"], "source"), "token", "price"))
    assert got == {"x": 3.0, "y": 0.0, "z": 9.0}
    coins = spark.createDataFrame([(0, 1, "BTC", "Bitcoin"), (1, 2, "btc", "Copy"), (2, 3, "X", "bitcoin")], "position int, coin_id long, symbol string, name string")
    asked = spark.createDataFrame([("Btc",), ("BITCOIN",), ("none",)], "text string")
    assert dict(values(assets.coin_ids(asked, coins), "text", "coin_id")) == {"Btc": 1, "BITCOIN": 1, "none": None}


# Sets die thirty days after their last addition
def test_known_sets_expire(spark):
    def sequential(rows, life):
        known, added, out = {}, {}, {}
        for u, ip, ok, ts, i in sorted(rows, key=lambda r: (r[3], r[4])):
            if u in added and (ts - added[u]).total_seconds() >= life:
                known[u], added = set(), {k: v for k, v in added.items() if k != u}
            seen = known.setdefault(u, set())
            out[i] = ip in seen
            if ok and ip not in seen:
                seen.add(ip)
                added[u] = ts
        return out

    rng = np.random.default_rng(6)
    at = T0 + np.cumsum(rng.exponential(4, 250)) * timedelta(days=1)
    rows = [(int(rng.integers(2)), f"ip{rng.integers(4)}", bool(rng.random() < 0.6), t.replace(microsecond=0), i) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "user_id long, ip string, success boolean, ts timestamp_ntz, id long")
    from tallyspark.plans.keyed import KeyedRows

    for limit in (1_000_000, 60):
        keyed = KeyedRows(df, ["user_id"], limit=limit)
        got = security.known_before(keyed, "user_id", "ip", F.col("success"), "known")
        assert dict(values(got, "id", "known")) == sequential(rows, security.KNOWN_LIFE)


def test_failure_counter_restarts_after_an_hour(spark):
    minutes = [0, 10, 20, 79, 139, 140]
    df = spark.createDataFrame([("u", i, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)], "u string, id long, ts timestamp_ntz")
    got = security.live_counter(df, ["u"], ["ts", "id"], 3600, "n").orderBy("id")
    assert values(got, "n") == [1, 2, 3, 4, 1, 2]


# D9 against brute force
def test_density_noise(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 120), rng.uniform(-40, 40, 60), np.zeros(50)]).round(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    near = np.abs(x[:, None] - x[None, :]) <= 0.5
    core = near.sum(1) >= 5
    want = ~(near & core[None, :]).any(1)
    for cells in (4096, 8):
        got = anomaly.density_noise(df, [], "x", cells_per_block=cells).orderBy("id")
        assert values(got, "noise") == want.tolist()


# D12 against a plain NumPy decomposition
def test_seasonal_residuals(spark):
    rng = np.random.default_rng(1)
    n, p = 260, 24
    x = 0.05 * np.arange(n) + np.sin(np.arange(n) * 2 * np.pi / p) + rng.normal(0, 0.2, n)
    x[100] += 5
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    got = anomaly.seasonal_anomalies(df, ["k"], ["t"], "x", p).orderBy("t")
    w = np.r_[0.5, np.ones(p - 1), 0.5] / p
    h = p // 2
    trend = np.full(n, np.nan)
    trend[h : n - h] = np.convolve(x, w, "valid")
    k, c = np.polyfit(np.arange(h, h + p), trend[h : h + p], 1)
    trend[:h] = k * np.arange(h) + c
    last = n - 1 - h
    k, c = np.polyfit(np.arange(last - p, last), trend[last - p : last], 1)
    trend[last + 1 :] = k * np.arange(last + 1, n) + c
    flat = x - trend
    season = np.array([flat[i::p].mean() for i in range(p)])
    resid = flat - (season - season.mean())[np.arange(n) % p]
    assert np.allclose([r["residual"] for r in got.collect()], resid)
    assert [r["t"] for r in got.filter("seasonal_anomaly").collect()] == list(np.flatnonzero(np.abs(resid) > 3 * resid.std(ddof=1)))


# The t limit
def test_t_limits():
    assert abs(anomaly.t_limit(2) - 9.924843) < 1e-5
    assert abs(anomaly.t_limit(98) - 2.626931) < 1e-4


# W4 against pandas, with blocks
def test_ema_blocks(spark):
    rng = np.random.default_rng(0)
    import pandas as pd

    x = rng.normal(100, 5, 2500)
    df = series(spark, x)
    spark.conf.set("spark.tally.hotKeyRows", "800")
    try:
        got = bars.exponential_averages(df).orderBy("ts").toPandas()
    finally:
        spark.conf.unset("spark.tally.hotKeyRows")
    s = pd.Series(x)
    macd = s.ewm(span=12).mean() - s.ewm(span=26).mean()
    assert np.allclose(got["ema_10"], s.ewm(span=10).mean(), rtol=0, atol=1e-11)
    assert np.allclose(got["macd_signal"], macd.ewm(span=9).mean(), rtol=0, atol=1e-11)
