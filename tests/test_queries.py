"""Every registered query that has SQL, against DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from trailmark.plans import corpus, curves, exchange, quality  # noqa: F401  they register their queries
from trailmark.plans.registry import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    """A value that compares alike from either engine: floats to nine digits, NaN as null."""
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def in_order(names, rows):
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(row[i]) for i in by) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = in_order(got.columns, got.collect()), in_order(names, want.fetchall())
    assert len(a) == len(b)
    assert all(x == y or all(p == q or (isinstance(p, float) and q is not None and math.isclose(p, float(q), rel_tol=1e-6, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    got = QUERIES[name](spark, str(DATA))
    assert got.count() > 0 or name == "flagged_snippets"  # so few snippets have no biased pair; test_operators flags some
