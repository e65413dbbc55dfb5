"""Every core query with a SQL equivalent against DuckDB, on whole tables."""

import os

import duckdb
import pytest

from tests.conftest import DATA, norm, rows
from veilmark.plans import audit, detection, pages, regions, structure, telemetry

MODULES = (structure, detection, regions, pages, telemetry, audit)
CASES = [(name, m.QUERIES[name], m.ORACLES[name]) for m in MODULES for name in m.QUERIES if name in m.ORACLES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_same_as_sql(spark, data, duck, name, query, sql):
    df = query(spark, data)
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows(df) == sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.ORACLES])
def test_runs(spark, data, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert query(spark, data).count() >= 0


def test_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
