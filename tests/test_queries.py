"""Every code-graph query against its SQL twin."""

import pytest

from kelpgraph import queries
from tests.oracle import rows_of, twin

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_twin(spark, name):
    got = rows_of(queries.Q[name](spark, SF))
    if name in queries.SQL:
        assert got == twin(SF, queries.SQL[name])
    else:
        assert got[1]


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(queries.Q) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
