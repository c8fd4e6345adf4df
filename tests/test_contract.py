"""The driver contract, and the SQL of every query on the smallest tables."""

import builtins
import importlib
import os
import sys

import pytest

import __spark_entry__ as entry
from quarrylight import catalogue as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float):
        return round(float(v), 5)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(own.SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert ours == theirs


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_training_data_operators(monkeypatch):
    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("quarrylight.llm") or name == "corpus_pipeline" or name == "quarrylight" and "llm" in (fromlist or ()):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for k in [k for k in sys.modules if k.startswith("quarrylight.llm") or k in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(builtins, "__import__", missing)
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(own.QUERIES) and set(alone.oracle_sql()) == set(own.SQL)
