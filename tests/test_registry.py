"""Driver contract: every registered query runs; SQL-checked ones match DuckDB.

Runs at sf0.001 (the smoke scale). Model queries (no oracle) are exercised by
the operator tests; here they only need to be registered.
"""

from __future__ import annotations

import importlib.util
import os

import duckdb
import pytest

from tabulyst.plans.registry import oracle_sql, queries
from tabulyst.plans.tables import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _load_tool():
    spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "tools", "check_oracle.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_points():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    qs, os_ = mod.queries(), mod.oracle_sql()
    assert len(qs) >= 70 and set(os_) <= set(qs)
    assert len(os_) >= 55


def test_entry_smoke(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() == 8 and "median" in df.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    tool = _load_tool()
    sp = queries()[name](spark, SF).toPandas()
    dk = con.execute(oracle_sql()[name]).df()
    assert tool.compare(name, sp, dk) == "ok"
