"""Every registered query against its SQL at the smallest scale; queries without SQL give rows."""

import pytest
from compare import connect, difference

from folioflow.queries import QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    why = difference(spark, con, name, sf)
    assert why is None, why
