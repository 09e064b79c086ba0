"""The registered queries against their SQL, on whole tables."""

import oracle
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, con, name):
    rows = queries.QUERIES[name](spark, SF).toArrow()
    assert rows.num_rows and not oracle.differences(rows, oracle.run(con, queries.ORACLES[name]))
