"""Registered queries against their SQL counterparts, on the smallest scale."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import DATA
from workload.queries import QUERIES


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = queries()[name](spark, DATA)
    cursor = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(([repr(row[c]) for c in order] for row in found.collect()))
    theirs = sorted(([repr(row[columns.index(c)]) for c in order] for row in cursor.fetchall()))
    assert ours == theirs
