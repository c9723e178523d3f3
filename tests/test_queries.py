"""Every registered query of the library's own operators against its SQL, or at least run to its end."""

import math

import pytest

from contractscope import plan_queries  # noqa: F401
from contractscope import queries as own
from tests.compare import both

SF = "/root/testdata/sf0.001"


def alike(x, y) -> bool:
    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(map(alike, x, y))
    return x == y


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, name):
    names, rows, sql_names, sql_rows = both(spark, SF, own.QUERIES[name], own.SQL[name])
    assert names == sql_names
    assert len(rows) == len(sql_rows)
    assert rows, "the query returns rows on the test tables"
    odd = [(a, b) for a, b in zip(rows, sql_rows, strict=True) if not alike(a, b)]
    assert not odd, odd[:3]


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0
