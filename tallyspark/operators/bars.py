"""OHLCV bars and technical indicators.

All fixed-frame indicators of a bar share one window specification, so Spark plans
one shuffle and one sort for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div
from tallyspark.plans.keyed import KeyedRows

KEY, ORDER = "symbol", "ts"

# Bar width by length of the requested span, in days.
SPAN_INTERVALS = [(1, "5 minutes"), (7, "1 hour"), (30, "2 hours"), (90, "6 hours")]
LONGEST_INTERVAL = "1 day"


def interval_for_days(days: int) -> str:
    for limit, interval in SPAN_INTERVALS:
        if days <= limit:
            return interval
    return LONGEST_INTERVAL


def resample(ticks: DataFrame, interval: str, key: str = KEY, ts: str = "ts", value: str = "value") -> DataFrame:
    """Bars from ticks; aggregates partially before the shuffle, so hot symbols are small."""
    grouped = ticks.groupBy(key, F.window(ts, interval).alias("_w")).agg(
        F.min_by(value, ts).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, ts).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return grouped.select(key, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def price_features(bars: DataFrame) -> DataFrame:
    return bars.withColumns(
        {
            "price_range": F.col("high") - F.col("low"),
            "price_change": F.col("close") - F.col("open"),
            "price_change_pct": safe_div(F.col("close") - F.col("open"), F.col("open")),
            "high_low_pct": safe_div(F.col("high") - F.col("low"), F.col("close")),
        }
    )


def calendar_features(bars: DataFrame, ts: str = ORDER) -> DataFrame:
    return bars.withColumns(
        {
            "day_of_week": F.weekday(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "is_month_end": (F.day(ts) > 25).cast("int"),
        }
    )


def _back(w: Window, n: int) -> Window:
    return w.rowsBetween(-(n - 1), 0)


def _full(agg: Column, w: Window, n: int) -> Column:
    """Null until the frame holds ``n`` rows."""
    return F.when(F.count(F.lit(1)).over(_back(w, n)) == n, agg)


def moving_columns(w: Window) -> dict[str, Column]:
    out = {}
    for n in (3, 5, 10):
        out[f"sma_{n}"] = _full(F.avg("close").over(_back(w, n)), w, n)
        out[f"volatility_{n}"] = _full(F.stddev("close").over(_back(w, n)), w, n)
        out[f"volume_sma_{n}"] = _full(F.avg("volume").over(_back(w, n)), w, n)
    return out


def short_moving_columns(w: Window) -> dict[str, Column]:
    """Windows of 3 and 5 that start with the first row."""
    out = {}
    for n in (3, 5):
        out[f"short_sma_{n}"] = F.avg("close").over(_back(w, n))
        out[f"short_volatility_{n}"] = F.coalesce(F.stddev("close").over(_back(w, n)), F.lit(0.0))
    return out


def bollinger_columns(w: Window) -> dict[str, Column]:
    mid = _full(F.avg("close").over(_back(w, 20)), w, 20)
    dev = _full(F.stddev("close").over(_back(w, 20)), w, 20)
    low, high = mid - 2 * dev, mid + 2 * dev
    return {
        "bb_middle": mid,
        "bb_upper": high,
        "bb_lower": low,
        "bb_position": safe_div(F.col("close") - low, high - low),
    }


def lag_columns(w: Window) -> dict[str, Column]:
    out = {}
    for n in (1, 3, 5, 10):
        out[f"close_lag_{n}"] = F.lag("close", n).over(w)
        out[f"volume_lag_{n}"] = F.lag("volume", n).over(w)
        out[f"price_change_lag_{n}"] = F.lag(F.col("close") - F.col("open"), n).over(w)
    return out


def target_columns(w: Window, ahead: int) -> dict[str, Column]:
    future = F.lead("close", ahead).over(w)
    last = F.lag("close", 1).over(w)
    return {
        "target": future,
        "target_return": safe_div(future - F.col("close"), F.col("close")),
        "direction": F.coalesce(F.lead("close", 1).over(w) > F.col("close"), F.lit(False)).cast("int"),
        "returns": safe_div(F.col("close") - last, last),
        "change": F.col("close") - last,
    }


def indicators(
    bars: DataFrame, build: Callable[[Window], dict[str, Column]], before: int, after: int = 0, key: str = KEY
) -> DataFrame:
    return KeyedRows(bars, [key], [ORDER]).rolling(before, after, build)


def rsi(bars: DataFrame, key: str = KEY) -> DataFrame:
    """RSI over 7 rows (null until full) and over 5 rows (from the first row)."""
    rows = KeyedRows(bars, [key], [ORDER])
    moves = rows.rolling(1, 0, lambda w: {"_move": F.col("close") - F.lag("close", 1).over(w)})
    gain = F.when(F.col("_move") > 0, F.col("_move")).otherwise(0.0)
    loss = F.when(F.col("_move") < 0, -F.col("_move")).otherwise(0.0)
    moves = moves.withColumns({"_gain": gain, "_loss": loss})

    def build(w: Window) -> dict[str, Column]:
        g7, l7 = F.avg("_gain").over(_back(w, 7)), F.avg("_loss").over(_back(w, 7))
        g5, l5 = F.avg("_gain").over(_back(w, 5)), F.avg("_loss").over(_back(w, 5))
        strong = F.when(l7 > 0, 100 - 100 / (1 + F.try_divide(g7, l7))).when(g7 > 0, 100.0)
        return {"rsi_7": _full(strong, w, 7), "rsi_5": 100 - 100 / (1 + g5 / (l5 + 1e-8))}

    return rows.on(moves).rolling(6, 0, build).drop("_move", "_gain", "_loss")


# Weights below this share of the newest one cannot change a double.
_NEGLIGIBLE = 1e-17


def _reach(span: int) -> int:
    keep = 1 - 2.0 / (span + 1)
    return math.ceil(math.log(_NEGLIGIBLE) / math.log(keep))


def exponential_averages(
    bars: DataFrame, spans: tuple[int, ...] = (3, 5, 10), macd: tuple[int, int, int] = (12, 26, 9), key: str = KEY
) -> DataFrame:
    """Adjusted EMAs, MACD and its signal line, in one linear pass per block.

    A block of a hot symbol starts with enough copied rows for every weight left
    out to vanish in double precision, so results equal those of the whole series.
    """
    fast, slow, signal = macd
    before = max([_reach(s) for s in spans] + [_reach(max(fast, slow)) + _reach(signal)])
    names = [f"ema_{s}" for s in spans] + ["macd", "macd_signal"]

    def ema(x: pd.Series, span: int) -> pd.Series:
        return x.ewm(span=span, adjust=True).mean()

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(ORDER)
        close = block["close"]
        out = block.assign(**{f"ema_{s}": ema(close, s) for s in spans})
        out["macd"] = ema(close, fast) - ema(close, slow)
        out["macd_signal"] = ema(out["macd"], signal)
        return out[~out["_halo"]].drop(columns=["_block", "_halo"])

    slim = bars.select(key, ORDER, "close")
    blocks = KeyedRows(slim, [key], [ORDER]).blocks(before)
    schema = ", ".join(f"{n} {t}" for n, t in slim.dtypes) + ", " + ", ".join(f"{n} double" for n in names)
    return blocks.groupBy(key, "_block").applyInPandas(fill, schema)


def enough_history(bars: DataFrame, least: int = 10, key: str = KEY) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    counts = bars.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return KeyedRows(bars, [key]).attach(counts).filter(F.col("_rows") >= least).drop("_rows")


def latest_change(bars: DataFrame, key: str = KEY) -> DataFrame:
    """Last close of each symbol, its change over the close before, and in percent.

    Uses only partial aggregates: the last bar, then the latest one before it.
    """
    last = bars.groupBy(key).agg(F.max(ORDER).alias("_last"))
    older = KeyedRows(bars, [key]).attach(last)
    both = older.groupBy(key).agg(
        F.max(ORDER).alias("last_ts"),
        F.max_by("close", ORDER).alias("close"),
        F.max_by("close", F.when(F.col(ORDER) < F.col("_last"), F.col(ORDER))).alias("previous_close"),
    )
    change = F.col("close") - F.coalesce("previous_close", "close")
    return both.withColumns({"change": change, "change_pct": safe_div(change, F.col("previous_close")) * 100})
