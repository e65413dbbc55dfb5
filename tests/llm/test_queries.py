"""The registered queries on the smallest tables."""

import duckdb
import pytest

from tests.conftest import DATA, norm, rows
from veilmark.llm import queries

COLUMNS = {
    "p1_found": ["page_id", "element_id"], "p2_found": ["page_id", "element_id", "field"], "p5_found": ["page_id", "element_id", "field", "pii_type"], "p7_found": ["page_id", "element_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    n = df.count()
    assert n > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.distinct().count() == n


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_as_sql(spark, data, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark_results AS SELECT * FROM '{DATA}/benchmark_results.parquet'")
    df = queries.QUERIES[name](spark, data)
    cur = c.execute(queries.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(x) for x in sorted(cols)]
    assert rows(df) == sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())


def test_mix_is_near_its_targets(spark, data):
    for r in queries.p9_shares(spark, data).collect():
        if not r["short"] and r["budget_tokens"]:
            assert abs(r["tokens"] - r["budget_tokens"]) <= 0.2 * r["budget_tokens"]
        assert r["most_copies"] <= r["max_repeats"]
