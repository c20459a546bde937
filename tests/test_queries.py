"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from tallyspark.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("check_queries", ROOT / "tools" / "check_queries.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

# Ordered per-key queries, run once more with tiny groups counted as hot.
HOT = {
    "running_balance": 4,
    "moving_averages": 40,
    "relative_strength": 40,
    "exponential_averages": 40,
    "price_targets_30": 40,
    "forward_back_fill": 10,
    "interpolated_readings": 10,
    "iqr_outliers": 20,
    "modified_z_outliers": 20,
    "density_noise": 20,
    "seasonal_anomalies": 60,
    "trend_anomalies": 20,
    "change_points": 60,
    "amount_frequency": 1,
    "price_percentiles": 100,
    "consensus_prices": 5,
    "nested_posts": 3,
    "quiz_results": 20,
    "lockouts": 30,
    "rate_limits": 30,
    "unusual_hours": 100,
    "ranking_metrics": 100,
    "stratified_folds": 10,
    "time_folds": 100,
}
# Model fits take long; one of each kind is exercised in test_models.
ROWS_ONLY = ["isolation_forest"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def compare(spark, con, name):
    got = check.rows_of(QUERIES[name].run(spark, SMALL).toArrow())
    want = check.rows_of(con.sql(QUERIES[name].sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[2] == want[2]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", HOT)
def test_matches_sql_with_hot_keys(spark, con, few_rows_are_hot, name):
    few_rows_are_hot(HOT[name])
    compare(spark, con, name)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name].run(spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
