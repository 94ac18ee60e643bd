"""Every registered query next to its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference
from checks.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")

# The grid of fits is covered by a unit test; here it would only repeat it slowly.
SLOW = {"run_grid"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    assert difference(spark, con, DATA, name) is None


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["topic", "npmi"]
