"""Files and stored tables: reading, saving, snapshots and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.ml.jobs import folder_size

# Write mode behind each name.
MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}

# Quotes inside a field are doubled, so quotes, separators and line breaks come back; spaces are kept.
CSV_FORMAT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Stored names of price columns.
PRICE_NAMES = {
    "Open": "open_price",
    "High": "high_price",
    "Low": "low_price",
    "Close": "close_price",
    "open": "open_price",
    "high": "high_price",
    "low": "low_price",
    "close": "close_price",
    "Volume": "volume",
}


def read_training_file(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A training CSV with its fixed schema; columns are matched by the header."""
    reader = spark.read.schema(schemas.TRAINING_FILES[kind]).options(**CSV_FORMAT)
    return reader.option("multiLine", True).option("enforceSchema", True).csv(path)


def csv_folder(name: str, as_of: str) -> str:
    """Folder name of a CSV export: names without ``.csv`` get a time stamp (yyyymmdd_HHMMSS)."""
    return name if name.endswith(".csv") else f"{name}_{as_of}.csv"


def save_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_FORMAT).mode("overwrite").csv(path)


def save_table(df: DataFrame, path: str, if_exists: str = "append", partition: Sequence[str] = ()) -> None:
    """Parquet table; ``append``, ``replace`` or ``fail``.  Months are stored as yyyy-MM text."""
    months = {
        c: F.date_format(c, "yyyy-MM") for c, t in df.dtypes if c == "year_month" and (t == "date" or "timestamp" in t)
    }
    out = df.withColumns(months).write.mode(MODES[if_exists])
    (out.partitionBy(*partition) if partition else out).parquet(path)


def load_table(
    spark: SparkSession, path: str, where: Column | str | None = None, params: Mapping[str, object] | None = None
) -> DataFrame:
    """A stored table, filtered by a Column or by SQL text with named parameters."""
    df = spark.read.parquet(path)
    if where is None:
        return df
    if isinstance(where, Column):
        return df.filter(where)
    return spark.sql(f"SELECT * FROM {{t}} WHERE {where}", args=dict(params or {}), t=df)


def normalise_prices(df: DataFrame, symbol: str | None = None, date_col: str = "date") -> DataFrame:
    """Stored names for price columns, a date column and the symbol."""
    out = df.withColumnsRenamed({k: v for k, v in PRICE_NAMES.items() if k in df.columns})
    if date_col != "date":
        out = out.withColumnRenamed(date_col, "date")
    out = out.withColumn("date", F.to_date("date"))
    return out if symbol is None else out.withColumn("symbol", F.lit(symbol))


def save_prices(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the symbols in ``df``; other symbols stay."""
    (
        df.dropDuplicates(["symbol", "date"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol")
        .parquet(path)
    )


def snapshot(spark: SparkSession, tables: Mapping[str, str], path: str, stamp: str) -> dict[str, str]:
    """Copies stored tables into ``snapshot=<stamp>``; returns the copies' paths."""
    out = {}
    for name, source in tables.items():
        out[name] = f"{path}/snapshot={stamp}/{name}"
        spark.read.parquet(source).write.mode("errorifexists").parquet(out[name])
    return out


def size_megabytes(spark: SparkSession, path: str) -> float:
    return folder_size(spark, path) / (1024 * 1024)


def duplicates(df: DataFrame, table: str) -> DataFrame:
    """Key values that occur more than once in a stored table."""
    keys = schemas.TABLE_KEYS[table]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
