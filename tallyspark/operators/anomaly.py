"""Statistical and time-series anomaly detection, per key or over a whole table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyspark.functions.exprs import safe_div
from tallyspark.operators.cleaning import observed
from tallyspark.plans.keyed import KeyedRows, table_quantiles, with_scalars
from tallyspark.plans.lineage import cut

# Detector limits.
Z_LIMIT = 3.0
Z_LEAST, IQR_LEAST, MAD_LEAST = 10, 4, 10
IQR_REACH = 1.5
MAD_SCALE, MAD_LIMIT = 0.6745, 3.5
ADAPTIVE_ABOVE = 100
SKEW_LIMIT, SKEW_FACTOR = 1.0, 1.2
KURTOSIS_LIMIT, KURTOSIS_FACTOR = 3.0, 1.1


def adaptive_limit(skewness: Column, kurtosis: Column) -> Column:
    """The z limit, wider for skewed and for heavy-tailed values (population moments)."""
    return (
        F.lit(Z_LIMIT)
        * F.when(F.abs(skewness) > SKEW_LIMIT, SKEW_FACTOR).otherwise(1.0)
        * F.when(kurtosis > KURTOSIS_LIMIT, KURTOSIS_FACTOR).otherwise(1.0)
    )


class Groups:
    """Per-key statistics joined onto rows; no keys means one group, the table."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.df, self.keys = df, list(keys)
        self.rows = KeyedRows(df, self.keys) if self.keys else None

    def aggregate(self, df: DataFrame, *aggs: Column) -> DataFrame:
        """Group statistics joined onto the rows they come from."""
        stats = df.groupBy(*self.keys).agg(*aggs) if self.keys else df.agg(*aggs)
        return self.join(df, stats)

    def quantiles(self, df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
        return self.join(df, self.rows.on(df).quantiles(wanted) if self.keys else table_quantiles(df, wanted))

    def join(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        return self.rows.on(df).attach(stats) if self.keys else with_scalars(df, stats)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def zscore_flags(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "z_outlier", adaptive: bool = True
) -> DataFrame:
    out = Groups(df, keys).aggregate(
        df,
        F.count(value).alias("_n"),
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_dev"),
        F.skewness(value).alias("_skew"),
        F.kurtosis(value).alias("_kurt"),
    )
    limit = F.lit(Z_LIMIT)
    if adaptive:
        limit = F.when(F.col("_n") > ADAPTIVE_ABOVE, adaptive_limit(F.col("_skew"), F.col("_kurt"))).otherwise(Z_LIMIT)
    score = F.abs(safe_div(F.col(value) - F.col("_mean"), F.col("_dev")))
    return out.withColumn(name, _flag((F.col("_n") >= Z_LEAST) & (score > limit))).drop(
        "_n", "_mean", "_dev", "_skew", "_kurt"
    )


def iqr_flags(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "iqr_outlier", reach: float = IQR_REACH
) -> DataFrame:
    groups = Groups(df, keys)
    out = groups.quantiles(df, {"_q1": (value, 0.25), "_q3": (value, 0.75)})
    out = groups.aggregate(out, F.count(value).alias("_n"))
    step = reach * (F.col("_q3") - F.col("_q1"))
    outside = (F.col(value) < F.col("_q1") - step) | (F.col(value) > F.col("_q3") + step)
    return out.withColumn(name, _flag((F.col("_n") >= IQR_LEAST) & outside)).drop("_q1", "_q3", "_n")


def modified_z_flags(df: DataFrame, keys: Sequence[str], value: str, name: str = "mad_outlier") -> DataFrame:
    groups = Groups(df, keys)
    out = groups.quantiles(df, {"_med": (value, 0.5)})
    out = out.withColumn("_away", F.abs(F.col(value) - F.col("_med")))
    out = groups.quantiles(out, {"_mad": ("_away", 0.5)})
    out = groups.aggregate(out, F.count(value).alias("_n"))
    score = MAD_SCALE * safe_div(F.col("_away"), F.col("_mad"))
    return out.withColumn(name, _flag((F.col("_n") >= MAD_LEAST) & (F.col("_mad") > 0) & (score > MAD_LIMIT))).drop(
        "_med", "_away", "_mad", "_n"
    )


def outlier_votes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds the three flags and ``votes``, their sum."""
    out = modified_z_flags(iqr_flags(zscore_flags(df, keys, value), keys, value), keys, value)
    flags = ("z_outlier", "iqr_outlier", "mad_outlier")
    return out.withColumn("votes", sum((F.col(f).cast("int") for f in flags), F.lit(0)))


def robust_scaled(df: DataFrame, keys: Sequence[str], value: str, name: str = "scaled") -> DataFrame:
    """(x - median) / IQR; a zero IQR divides by 1."""
    out = Groups(df, keys).quantiles(df, {"_q1": (value, 0.25), "_q2": (value, 0.5), "_q3": (value, 0.75)})
    width = F.col("_q3") - F.col("_q1")
    scaled = (F.col(value) - F.col("_q2")) / F.when(width == 0, 1.0).otherwise(width)
    return out.withColumn(name, scaled).drop("_q1", "_q2", "_q3")


def detect(df: DataFrame, keys: Sequence[str], value: str, method: str = "ensemble", id_col: str = "id") -> DataFrame:
    """Adds ``anomaly``: statistical = z-score, ensemble = z-score or IQR, ml = forest and noise."""
    if method == "statistical":
        return zscore_flags(df, keys, value, name="anomaly")
    if method == "ensemble":
        out = iqr_flags(zscore_flags(df, keys, value), keys, value)
        return out.withColumn("anomaly", F.col("z_outlier") | F.col("iqr_outlier")).drop("z_outlier", "iqr_outlier")
    if method == "ml":
        from tallyspark.ml.iforest import forest_and_noise

        return forest_and_noise(df, value, id_col)
    raise ValueError(f"unknown method {method!r}")


def handle_outliers(
    df: DataFrame, columns: Sequence[str], target: str | None = None, least: int = 10, watches: dict | None = None
) -> DataFrame:
    """Column by column: clip the target to its 1st-99th percentile if any value has
    two votes; drop rows where another column has three.  Later columns see the rows
    left by earlier ones, so each step ends in a reliable checkpoint.

    ``watches`` gets an observation per column: rows, outliers (two votes), and values clipped or rows removed."""
    kept = df.columns
    watches = {} if watches is None else watches
    for i, c in enumerate(columns):
        voted = outlier_votes(df, [], c)
        if c == target:
            limits = table_quantiles(df, {"_p1": (c, 0.01), "_p99": (c, 0.99)})
            found = voted.agg(F.coalesce(F.max(F.col("votes") >= 2), F.lit(False)).alias("_found"), F.count_if(F.col("votes") >= 2).alias("_outliers"))
            bounded = with_scalars(with_scalars(df, limits), found)
            clipped = F.greatest(F.least(F.col(c), F.col("_p99")), F.col("_p1"))
            watches[c] = Observation(f"outliers {c}")
            changed = F.count_if(F.col("_found") & (clipped != F.col(c)))
            bounded = bounded.observe(watches[c], F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("_outliers"), F.lit(0)).alias("outliers"), changed.alias("changed"))
            df = bounded.withColumn(
                c, F.when(F.col("_found") & F.col(c).isNotNull(), clipped).otherwise(F.col(c))
            ).select(*kept)
        else:
            voted, watches[c] = observed(voted, f"outliers {c}", outliers=F.col("votes") >= 2, changed=F.col("votes") >= 3)
            df = voted.filter(F.col("votes") < 3).select(*kept)
        if i + 1 < len(columns):
            df = cut(df)
    return df


# -- one-dimensional density noise ---------------------------------------------


def density_noise(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    eps: float = 0.5,
    least: int = 5,
    name: str = "noise",
    cells_per_block: int = 4096,
) -> DataFrame:
    """Flags values that are neither dense nor within ``eps`` of a dense value.

    A cell of width ``eps`` with ``least`` values is dense throughout, so only its
    few outermost values matter to its neighbours.  Thinned that way, no cell holds
    more than ``2 * least`` rows, and blocks of cells are counted with a range frame;
    no pairs are formed.
    """
    keys = list(keys)
    if not keys:
        df = df.withColumn("_all", F.lit(0))
        return density_noise(df, ["_all"], value, eps, least, name, cells_per_block).drop("_all")
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", F.floor(F.col("_v") / eps))
    )
    cells = distinct.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_held"))
    per_cell = Window.partitionBy(*keys, "_cell")

    def outermost(order: Column) -> DataFrame:
        # Spark limits each group before the shuffle, so a dense cell stays small.
        return distinct.withColumn("_r", F.row_number().over(per_cell.orderBy(order))).filter(F.col("_r") <= least)

    thin = outermost(F.col("_v").asc()).unionByName(outermost(F.col("_v").desc())).drop("_r").distinct()
    thin = thin.join(cells, [*keys, "_cell"])
    block = F.floor(F.col("_cell") / cells_per_block)
    at = F.pmod(F.col("_cell"), F.lit(cells_per_block))
    # Rows of the three outer cells are copied over, enough for a frame of a frame.
    copies = F.array_compact(
        F.array(
            F.struct(block.alias("b"), F.lit(False).alias("halo")),
            F.when(at < 3, F.struct((block - 1).alias("b"), F.lit(True).alias("halo"))),
            F.when(at >= cells_per_block - 3, F.struct((block + 1).alias("b"), F.lit(True).alias("halo"))),
        )
    )
    spread = thin.withColumn("_copy", F.explode(copies)).select("*", "_copy.b", "_copy.halo").drop("_copy")
    parts = ", ".join(f"`{k}`" for k in [*keys, "b"])
    near = f"OVER (PARTITION BY {parts} ORDER BY _v RANGE BETWEEN {eps!r}D PRECEDING AND {eps!r}D FOLLOWING)"
    marked = spread.withColumn("_core", F.expr(f"int(_held >= {least} OR sum(_c) {near} >= {least})"))
    lonely = (
        marked.withColumn("_near", F.expr(f"max(_core) {near}"))
        .filter(~F.col("halo") & (F.col("_near") == 0))
        .select(*keys, F.col("_v").alias(value), F.lit(True).alias(name))
    )
    rows = KeyedRows(df, [*keys, value]).attach(lonely)
    return rows.withColumn(name, F.coalesce(name, F.lit(False)))


# -- time series ---------------------------------------------------------------

SEASON_LEAST, SEASON_PERIOD, SEASON_LIMIT = 200, 30, 3.0
TREND_LEAST, TREND_LIMIT, TREND_WIDEST = 20, 2.5, 20
CHANGE_LEAST, CHANGE_WIDEST, CHANGE_P = 20, 50, 0.01


def seasonal_anomalies(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: int | None = None
) -> DataFrame:
    """Flags residuals beyond three deviations after removing trend and season.

    Trend: centred average over one period, continued at both ends by a line through
    the nearest ``period`` trend points.  Season: mean of each phase, centred.  The
    automatic period is min(rows / 4, 30), which is 30 from the 200 rows required.
    """
    period = period or SEASON_PERIOD
    half = period // 2
    counted = KeyedRows(df, keys, order)
    at = counted.running({"_at": ("count", F.lit(1))}).withColumn("_at", F.col("_at") - 1)
    at = counted.on(at).attach(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    at = at.filter(F.col("_n") >= SEASON_LEAST)

    def centred(w: Window) -> dict[str, Column]:
        if period % 2:
            total = F.sum(value).over(w.rowsBetween(-half, half))
        else:
            inner = F.sum(value).over(w.rowsBetween(-half + 1, half - 1))
            total = inner + 0.5 * (F.lag(value, half).over(w) + F.lead(value, half).over(w))
        inside = (F.col("_at") >= half) & (F.col("_at") < F.col("_n") - half)
        return {"_trend": F.when(inside, total / period)}

    rows = counted.on(at).rolling(half, half, centred)
    first_end, last_start = half + period, F.col("_n") - 1 - half - period
    head = F.col("_trend").isNotNull() & (F.col("_at") < first_end)
    tail = F.col("_trend").isNotNull() & (F.col("_at") >= last_start) & (F.col("_at") < F.col("_n") - 1 - half)
    lines = rows.groupBy(*keys).agg(
        *[
            f(F.when(cond, F.col("_trend")), F.when(cond, F.col("_at").cast("double"))).alias(f"_{kind}_{side}")
            for side, cond in (("head", head), ("tail", tail))
            for kind, f in (("k", F.regr_slope), ("c", F.regr_intercept))
        ]
    )
    rows = counted.on(rows).attach(lines)
    trend = (
        F.when(F.col("_trend").isNotNull(), F.col("_trend"))
        .when(F.col("_at") < half, F.col("_k_head") * F.col("_at") + F.col("_c_head"))
        .otherwise(F.col("_k_tail") * F.col("_at") + F.col("_c_tail"))
    )
    rows = rows.withColumns({"_flat": F.col(value) - trend, "_phase": F.pmod(F.col("_at"), F.lit(period))})
    phases = rows.groupBy(*keys, "_phase").agg(F.avg("_flat").alias("_season"))
    level = phases.groupBy(*keys).agg(F.avg("_season").alias("_level"))
    phases = phases.join(level, keys).select(*keys, "_phase", (F.col("_season") - F.col("_level")).alias("_season"))
    rows = counted.on(rows).attach(phases, extra=["_phase"])
    rows = rows.withColumn("residual", F.col("_flat") - F.col("_season"))
    rows = counted.on(rows).attach(rows.groupBy(*keys).agg(F.stddev("residual").alias("_dev")))
    flagged = rows.withColumn("seasonal_anomaly", F.abs("residual") > SEASON_LIMIT * F.col("_dev"))
    return flagged.select(*df.columns, "residual", "seasonal_anomaly")


def _long_and_short(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], long_from: int, short_from: int
) -> tuple[KeyedRows, DataFrame, DataFrame]:
    """Rows with ``_n``, split by series length; short series have fewer than ``long_from`` rows."""
    rows = KeyedRows(df, keys, order)
    sized = rows.attach(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    short = sized.filter((F.col("_n") >= short_from) & (F.col("_n") < long_from))
    return rows.on(sized.filter(F.col("_n") >= long_from)), short, sized.filter(F.col("_n") < short_from)


def trend_anomalies(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Flags values beyond 2.5 rolling deviations from the rolling mean.

    The window is min(rows / 4, 20): a constant frame for series of 80 rows or more,
    a small grouped function (under 80 rows per group) for shorter ones.
    """
    long, short, tiny = _long_and_short(df, keys, order, 4 * TREND_WIDEST, TREND_LEAST)

    def build(w: Window) -> dict[str, Column]:
        frame = w.rowsBetween(-(TREND_WIDEST - 1), 0)
        full = F.count(F.lit(1)).over(frame) == TREND_WIDEST
        away = F.abs(F.col(value) - F.avg(value).over(frame)) / (F.stddev(value).over(frame) + 1e-8)
        return {"trend_anomaly": _flag(full & (away > TREND_LIMIT))}

    out = long.rolling(TREND_WIDEST - 1, 0, build).drop("_n")

    def small(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order))
        roll = group[value].rolling(min(len(group) // 4, TREND_WIDEST))
        away = (group[value] - roll.mean()).abs() / (roll.std() + 1e-8)
        return group.assign(trend_anomaly=away > TREND_LIMIT).drop(columns="_n")

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", trend_anomaly boolean"
    few = short.groupBy(*keys).applyInPandas(small, schema)
    none = tiny.drop("_n").withColumn("trend_anomaly", F.lit(False))
    columns = [*df.columns, "trend_anomaly"]
    return out.select(columns).unionByName(few.select(columns)).unionByName(none.select(columns))


def two_sided_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t for an even number of degrees of freedom."""
    cos2 = 1 / (1 + t * t / df)
    term = total = 1.0
    for k in range(1, df // 2):
        term *= (2 * k - 1) / (2 * k) * cos2
        total += term
    return 1 - math.sqrt(1 - cos2) * total


def t_limit(df: int, p: float = CHANGE_P) -> float:
    """The t beyond which the two-sided p-value falls under ``p`` (bisection)."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if two_sided_p(mid, df) > p else (lo, mid)
    return hi


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Positions where the means of the rows before and from here differ (p < 0.01).

    Two-sample t-test with equal variances over min(rows / 10, 50) rows each side.
    Returns the rows of the change points with their 0-based ``position``.
    """
    widest = CHANGE_WIDEST
    long, short, _ = _long_and_short(df, keys, order, 10 * widest, CHANGE_LEAST)
    limits = np.array([0.0, 0.0] + [t_limit(2 * w - 2) for w in range(2, widest + 1)])
    placed = long.running({"position": ("count", F.lit(1))}).withColumn("position", F.col("position") - 1)

    def build(w: Window) -> dict[str, Column]:
        before, after = w.rowsBetween(-widest, -1), w.rowsBetween(0, widest - 1)
        gap = F.avg(value).over(before) - F.avg(value).over(after)
        pooled = (F.var_samp(value).over(before) + F.var_samp(value).over(after)) / widest
        return {"_gap": gap, "_pooled": pooled}

    tested = long.on(placed).rolling(widest, widest - 1, build)
    inside = (F.col("position") >= widest) & (F.col("position") < F.col("_n") - widest)
    differs = F.abs("_gap") > F.lit(float(limits[widest])) * F.sqrt("_pooled")
    found = tested.filter(inside & differs)

    def small(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order))
        x = group[value].to_numpy(dtype=float)
        w = min(len(x) // 10, widest)
        sides = np.lib.stride_tricks.sliding_window_view(x, w)
        at = np.arange(w, len(x) - w)
        before, after = sides[at - w], sides[at]
        pooled = (before.var(axis=1, ddof=1) + after.var(axis=1, ddof=1)) / w
        hit = np.abs(before.mean(axis=1) - after.mean(axis=1)) > limits[w] * np.sqrt(pooled)
        return group.iloc[at[hit]].assign(position=at[hit]).drop(columns="_n")

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", position long"
    columns = [*df.columns, "position"]
    return found.select(columns).unionByName(short.groupBy(*keys).applyInPandas(small, schema).select(columns))


# -- monitoring ----------------------------------------------------------------


def latest_window(df: DataFrame, keys: Sequence[str], order: str, size: int = 100) -> DataFrame:
    """The newest ``size`` rows of each key; groups are limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r")


def monitor(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    detector: Callable[[DataFrame, Sequence[str], str], DataFrame],
    size: int = 100,
) -> DataFrame:
    """Anomalies among the newest values of each key, by any ``rows -> rows + anomaly`` detector."""
    recent = latest_window(df.filter(F.col(value).isNotNull()), keys, order, size)
    checked = detector(recent, keys, value)
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if("anomaly").alias("anomaly_count")
    )


# Alert limit, window and severity factor.
ALERT_LEAST, ALERT_WINDOW, ALERT_SLIDE, ALERT_HIGH = 10, "5 minutes", "1 minute", 2


def alerts(checks: DataFrame, key: str, ts: str, window: str = ALERT_WINDOW, slide: str = ALERT_SLIDE) -> DataFrame:
    """Alerts where ``ALERT_LEAST`` anomalous checks fall into one sliding window.

    Works on batch rows and, with a watermark set on ``ts``, on a stream.
    """
    counted = checks.groupBy(key, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("anomaly_count"))
    severity = F.when(F.col("anomaly_count") > ALERT_LEAST * ALERT_HIGH, "high").otherwise("medium")
    return counted.filter(F.col("anomaly_count") >= ALERT_LEAST).select(
        key, F.col("w.start").alias("window_start"), "anomaly_count", severity.alias("severity")
    )
