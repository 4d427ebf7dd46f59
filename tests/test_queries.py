"""Every registered core query against its SQL on the smallest tables."""

import pytest

from compare import agree, duck
from plumbline.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(data_dir):
    return duck(data_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, data_dir, con):
    df = registry.queries()[name](spark, data_dir)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        agree(df, con.sql(sql))


def test_entry(spark, data_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
