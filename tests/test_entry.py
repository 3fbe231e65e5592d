"""The driver's contract: every query runs, and equals its SQL form on the smallest tables."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from logweave.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def spelled(rows):
    def cell(x):
        return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    listed = ", ".join(columns)
    got = tables.sql(f"select {listed} from ({ORACLE_SQL[name]})").fetchall()
    assert spelled(df.select(*columns).collect()) == spelled(got)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib

    blocked = {name: None for name in list(sys.modules) if name.startswith("logweave.llm") or name == "corpus_pipeline"}
    for name in {*blocked, "logweave.llm", "corpus_pipeline"}:
        monkeypatch.setitem(sys.modules, name, None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
