"""Every registered query against its SQL on the small tables."""

from pathlib import Path

import oracle
import pytest

from quern.plans import catalogue, statements  # noqa: F401  each registers its queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    rows = catalogue.QUERIES[name](spark, SF).toArrow()
    if name in catalogue.ORACLES:
        assert not oracle.differences(rows, oracle.run(con, catalogue.ORACLES[name]))
    else:
        assert rows.num_rows > 0
