import os

import pytest

from tests.compare import DATA, same
from tidewell.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
