"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from siftrow.plans.queries import ORACLE, QUERIES
from tools.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        assert compare(frame, duck, ORACLE[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
