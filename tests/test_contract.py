"""Driver contract: entry smoke, every query has an oracle, and both agree (sf0.001)."""

import os

import duckdb
import pytest
from conftest import ROOT, SF0001

import __spark_entry__ as contract
from compliance_scan.plans.queries import QUERIES

TABLES = ("customer", "orders")


def _norm(v):
    return "NULL" if v is None else str(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_entry_smoke(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert df.columns == ["detector_id", "risk_level", "file_path", "line_number", "snippet",
                          "message", "related_laws"]
    assert len(rows) == 1021


def test_every_query_has_oracle_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert os.path.exists(os.path.join(ROOT, "bench.py"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = contract.queries()[name](spark, SF0001)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(contract.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _bag(df.columns, s_rows) == _bag(d_cols, d_rows)
    assert len(s_rows) > 0
