"""Every registered query against the second engine, on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import oracle, same_as_oracle

from pliego.queries import QUERIES, SQL

#: Queries whose result is empty on tables this small.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, sf, con, name):
    n = same_as_oracle(QUERIES[name](spark, sf), con, SQL[name])
    assert n > 0 or name in EMPTY


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "id_contrato"


def test_sample_is_deterministic(spark, sf):
    a, b = ([r[0] for r in QUERIES["deterministic_sample"](spark, sf).collect()] for _ in range(2))
    assert a == b and len(set(a)) == 50
