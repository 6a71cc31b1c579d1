"""Every core query runs on sf0.001; those with an oracle agree with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from pairlab.plans import catalog
from pairlab.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
#: Queries without SQL: their scorers and readers have brute-force tests of their own.
UNCHECKED = {"slot_matches", "rouge_l", "score_table", "segment_score_table", "evaluate_runs"}


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = round(v, 4)
            elif hasattr(v, "item"):
                v = v.item()
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "bleu" in df.columns


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name in UNCHECKED and rows
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(df.columns)
    assert _norm(rows, df.columns) == _norm(cur.fetchall(), dcols)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
