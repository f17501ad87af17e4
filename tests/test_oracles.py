"""Every registered reference query against its SQL oracle on the smallest tables."""

import pytest

from ledgerloom.plans.registry import ORACLES, QUERIES
from tests.compare import assert_same
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
