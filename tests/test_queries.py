"""Every query of the library against its SQL, and those without SQL for rows and schema."""

import pytest

from tarnwell.plans import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert spark_rows(df) == sql_rows(con, ORACLES[name])
    else:
        assert df.count() >= 1
