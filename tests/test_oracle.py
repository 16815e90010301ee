"""Every query with reference SQL agrees with it; the others run and keep their schema."""

import pytest

from lacuna.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def duck(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_small, duck):
    df = QUERIES[name](spark, sf_small)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark, sf_small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
