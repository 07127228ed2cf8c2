"""Every registered query against its SQL on the smallest data folder."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, duck

# At this size the result is rightly empty; the larger folder covers them.
EMPTY = {"recall_search_by_product", "recall_candidates"}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, small, name):
    problem = difference(spark, con, small, queries()[name], oracle_sql().get(name))
    if name in EMPTY and problem == "no rows on either side":
        return
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_name_known_queries():
    assert set(oracle_sql()) <= set(queries())
