"""Every registered query against its SQL; those without SQL give rows of a stable schema."""

import pytest

from tessella.plans import all_oracles, all_queries
from tests.oracle import DATA, same

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
