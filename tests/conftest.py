import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def few_rows_are_hot(spark):
    """Makes every key with more than a handful of rows take the hot-key plans."""

    def use(limit):
        spark.conf.set("spark.tally.hotKeyRows", str(limit))

    yield use
    spark.conf.unset("spark.tally.hotKeyRows")


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
