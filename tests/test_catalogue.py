"""Every query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans.oracle import SQL
from tidemark.plans.queries import CATALOGUE


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(rows, columns):
    """Columns by name, rows by what is not a float, then by the floats."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: ([repr(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


def same(x, y):
    """Equal; floats up to a unit of their last kept digit, as sums may run in another order."""
    return math.isclose(x, y, rel_tol=1e-12, abs_tol=1.5e-6) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = CATALOGUE[name](spark, sf)
    relation = duck.sql(SQL[name])
    (names, got), (wanted, want) = canonical([tuple(r) for r in df.collect()], df.columns), canonical(relation.fetchall(), relation.columns)
    assert names == wanted and len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(CATALOGUE) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    CATALOGUE[name](spark, sf).collect()
