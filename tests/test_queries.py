"""Every query of the library runs; those with SQL give its rows."""

import pytest

from strataline import plans
from tests.oracle import compare, duck

#: No rows are to be expected of these at the smallest scale.
MAY_BE_EMPTY = {"or_join_split_first_seen", "annual_series", "dedupe_anti_url", "stream_breaker"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.ORACLE:
        assert compare(df, con, plans.ORACLE[name]) == ""
    else:
        assert df.count() > 0 or name in MAY_BE_EMPTY
