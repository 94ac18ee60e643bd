"""Those queries of the package that have SQL, next to it on the smallest tables."""

from pathlib import Path

import pytest

from checks.compare import connect, difference
from civictopics.llm.oracles import ORACLES
from civictopics.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    assert difference(spark, con, DATA, name) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
