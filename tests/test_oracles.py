"""Every query of the library against its DuckDB form, on the smallest tables."""

import pytest

from cartoflow.queries import ORACLES, QUERIES
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_duckdb(spark, con, name):
    agree(spark, con, QUERIES[name], ORACLES[name], SF)
