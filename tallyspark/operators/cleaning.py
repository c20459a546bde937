"""Cleaning of financial records.

Steps whose result depends on the data (which columns to drop, which fill to use)
first run one profiling aggregate, then build a plain column list; only counts and
ratios reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tallyspark.functions.exprs import strip_number
from tallyspark.plans.keyed import KeyedRows, all_of, table_quantiles, with_scalars


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith("timestamp") or t == "date"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# -- rows and columns ----------------------------------------------------------


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    filled = df.agg(*[F.count(quoted(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if filled[i] > 0])


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def drop_zero_rows(df: DataFrame) -> DataFrame:
    """Drops rows whose numeric columns are all 0; a null is not 0."""
    columns = numeric_columns(df)
    if not columns:
        return df
    return df.filter(~all_of([F.coalesce(F.col(c) == 0, F.lit(False)) for c in columns]))


def basic_cleaning(df: DataFrame) -> DataFrame:
    return drop_zero_rows(normalise_names(drop_empty_columns(drop_empty_rows(df)).dropDuplicates()))


def drop_constant_columns(df: DataFrame, columns: Sequence[str], least_variance: float = 1e-10) -> DataFrame:
    """Drops named numeric columns with one distinct value or (almost) no variance."""
    stats = []
    for i, c in enumerate(columns):
        stats.append((F.min(c) < F.max(c)).alias(f"d{i}"))
        stats.append(F.var_samp(c).alias(f"v{i}"))
    seen = df.agg(*stats).first()
    gone = [
        c for i, c in enumerate(columns) if not seen[f"d{i}"] or seen[f"v{i}"] is None or seen[f"v{i}"] < least_variance
    ]
    return df.drop(*gone)


# -- missing values ------------------------------------------------------------


def missing_ratios(df: DataFrame) -> DataFrame:
    """One row: share of nulls per column."""
    return df.agg(*[(F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in df.columns])


def forward_back_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last value before a gap, else the first value after it."""
    rows = KeyedRows(df, keys, order)
    ahead = rows.running({f"_f_{c}": ("last", F.col(c)) for c in columns})
    both = rows.on(ahead).running({f"_b_{c}": ("last", F.col(c)) for c in columns}, reverse=True)
    return both.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}")) for c in columns}).drop(
        *[f"_{d}_{c}" for c in columns for d in "fb"]
    )


def interpolate(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing ones take the last value."""
    keyed = KeyedRows(df, keys, order)
    placed = keyed.on(keyed.running({"_at": ("count", F.lit(1))}))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col("_at").alias("at")))

    before = placed.running({f"_p_{c}": ("last", known(c)) for c in columns})
    rows = placed.on(before).running({f"_n_{c}": ("last", known(c)) for c in columns}, reverse=True)

    def fill(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        step = (n["v"] - p["v"]) * (F.col("_at") - p["at"]) / (n["at"] - p["at"])
        return F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(n.isNull(), p["v"]).otherwise(p["v"] + step)

    return rows.withColumns({c: fill(c) for c in columns}).drop(
        "_at", *[f"_{d}_{c}" for c in columns for d in "pn"]
    )


def smallest_mode(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent non-null value, the smallest one among equals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    # Smallest value first among equal counts: a one-row top-k.
    return counts.orderBy(F.col("_n").desc(), F.col(column).asc()).limit(1).select(column)


def fill_missing(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill by the share of missing values of each column.

    Above 80 %: drop the column.  Numbers: below 10 % forward then backward fill,
    below 30 % median, else linear interpolation.  Text: mode, else ``unknown``.
    Key and order columns are left alone.
    """
    fixed = {*keys, *order}
    candidates = [c for c in df.columns if c not in fixed]
    ratios = missing_ratios(df.select(*candidates)).first().asDict()
    df = df.drop(*[c for c in candidates if ratios[c] is not None and ratios[c] > 0.8])
    left = [c for c in candidates if c in df.columns and ratios[c]]
    numbers = [c for c in numeric_columns(df) if c in left]
    carried = [c for c in numbers if ratios[c] < 0.1]
    centred = [c for c in numbers if 0.1 <= ratios[c] < 0.3]
    drawn = [c for c in numbers if ratios[c] >= 0.3]
    texts = [c for c in string_columns(df) if c in left]
    medians = table_quantiles(df, {f"_m_{c}": (c, 0.5) for c in centred}) if centred else None
    modes = {c: smallest_mode(df, c).scalar() for c in texts}
    if centred:
        df = with_scalars(df, medians)
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in centred}).drop(
            *[f"_m_{c}" for c in centred]
        )
    if texts:
        df = df.withColumns({c: F.coalesce(F.col(c), modes[c], F.lit("unknown")) for c in texts})
    if carried:
        df = forward_back_fill(df, carried, keys, order)
    if drawn:
        df = interpolate(df, drawn, keys, order)
    return df


# -- formats -------------------------------------------------------------------

# Name parts that mark a date column, and shares.
DATE_NAME_PARTS = ["date", "time", "created", "updated", "timestamp"]
DATE_SHARE = 0.5
NUMBER_SHARE = 0.7


def detect_formats(df: DataFrame) -> dict[str, str]:
    """``date`` or ``number`` for text columns that hold dates or numbers.

    The verdict comes from the shares over all values, counted in one pass.
    """
    counts = []
    for c in string_columns(df):
        v = F.lower(F.trim(c))
        counts += [F.count(v).alias(f"n_{c}"), F.count(v.try_cast("timestamp")).alias(f"d_{c}"), F.count(strip_number(v)).alias(f"x_{c}")]
    seen = df.agg(*counts).first() if counts else {}
    found = {}
    for c in string_columns(df):
        if any(p in c.lower() for p in DATE_NAME_PARTS):
            found[c] = "date"
            continue
        values = seen[f"n_{c}"]
        if values and seen[f"d_{c}"] / values > DATE_SHARE:
            found[c] = "date"
        elif values and seen[f"x_{c}"] / values > NUMBER_SHARE:
            found[c] = "number"
    return found


def standardise_formats(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Trims and lowers text, then converts date and number columns; bad values are null."""
    formats = detect_formats(df) if formats is None else formats
    out = {}
    for c in string_columns(df):
        text = F.lower(F.trim(c))
        kind = formats.get(c)
        out[c] = (
            text.try_cast("timestamp_ntz") if kind == "date" else strip_number(text) if kind == "number" else text
        )
    return df.withColumns(out)


# -- derived columns and rules -------------------------------------------------


def quality_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: str = "amount",
    at: str | None = None,
) -> DataFrame:
    """Completeness, time parts, amount size and a rolling mean and deviation of 10 rows."""
    width = len(df.columns)
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    times = [at] if at else time_columns(df)
    out = df.withColumn("_record_completeness", filled / F.lit(width))
    if times:
        out = out.withColumns(
            {
                "_hour": F.hour(times[0]),
                "_day_of_week": F.weekday(times[0]),
                "_is_weekend": F.weekday(times[0]) >= 5,
            }
        )
    if amount in df.columns:
        out = large_amounts(out, amount)
        enough = with_scalars(rolling_amount(out, keys, order, amount), out.agg((F.count(F.lit(1)) > 10).alias("_enough")))
        rolled = ("_amount_rolling_mean", "_amount_rolling_std")
        out = enough.withColumns({c: F.when(F.col("_enough"), F.col(c)) for c in rolled}).drop("_enough")
    return out


def large_amounts(df: DataFrame, amount: str = "amount") -> DataFrame:
    sized = df.withColumn("_amount_abs", F.abs(amount))
    limit = table_quantiles(sized, {"_p95": ("_amount_abs", 0.95)})
    return (
        with_scalars(sized, limit)
        .withColumn("_is_large_transaction", F.coalesce(F.col("_amount_abs") > F.col("_p95"), F.lit(False)))
        .drop("_p95")
    )


def rolling_amount(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str = "amount") -> DataFrame:
    def build(w):
        frame = w.rowsBetween(-9, 0)
        return {
            "_amount_rolling_mean": F.avg(amount).over(frame),
            "_amount_rolling_std": F.stddev(amount).over(frame),
        }

    return KeyedRows(df, keys, order).rolling(9, 0, build)


def repair_signs(df: DataFrame, kind: str = "transaction_type", amount: str = "amount") -> DataFrame:
    """Credits become positive and debits negative."""
    k, a = F.coalesce(F.col(kind), F.lit("")), F.col(amount)
    flipped = F.when(k.contains("credit") & (a < 0), -a).otherwise(a)
    return df.withColumn(amount, F.when(k.contains("debit") & (flipped > 0), -flipped).otherwise(flipped))


def drop_impossible_times(df: DataFrame, as_of: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Drops rows with a time after ``as_of`` or before 1900; nulls stay."""
    oldest = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    for c in columns if columns is not None else time_columns(df):
        value = F.col(c).cast("timestamp_ntz")
        df = df.filter(F.col(c).isNull() | ((value <= as_of.cast("timestamp_ntz")) & (value >= oldest)))
    return df


# Limits and allowed types of the record rules.
AMOUNT_RANGE = (-1_000_000, 1_000_000_000)
RECORD_TYPES = ["debit", "credit", "transfer", "payment", "refund"]


def validate_records(df: DataFrame) -> DataFrame:
    """Adds ``errors``, the list of broken rules; an empty list means a valid row."""
    kind = F.lower("transaction_type")
    low, high = AMOUNT_RANGE
    checks = F.array(
        F.when(F.col("timestamp").isNull(), "timestamp is required"),
        F.when(F.col("user_id").isNull(), "user_id is required"),
        F.when(F.col("amount").isNull(), "amount is required"),
        F.when(F.col("amount") < low, "amount too negative"),
        F.when(F.col("amount") > high, "amount too large"),
        F.when(kind.isNull() | ~kind.isin(RECORD_TYPES), "invalid transaction type"),
    )
    return df.withColumn("transaction_type", kind).withColumn("errors", F.array_compact(checks))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_records(df)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def observed(df: DataFrame, name: str, **counters: Column):
    """Row counters gathered while the rows flow by (no extra pass)."""
    from pyspark.sql import Observation

    watch = Observation(name)
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()]]
    return df.observe(watch, *aggs), watch
