"""Every registered query against its SQL counterpart."""

import importlib
import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

CORPUS = "threadlens.llm.queries"
EXTRA = importlib.util.find_spec("threadlens.llm") and importlib.util.find_spec(CORPUS)
SEPARATE = {*importlib.import_module(CORPUS).QUERIES, "pipeline"} if EXTRA else set()
QUERIES = {n: q for n, q in driver.queries().items() if n not in SEPARATE}
ORACLES = {n: q for n, q in driver.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    wanted = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    got = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)
    assert got == want


def test_entry(spark, sf_dir):
    assert driver.entry(spark).columns == ["id", "root", "depth", "path"]
