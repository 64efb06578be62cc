import os

import pytest

from tests.compare import DATA, same
from tidewell.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
