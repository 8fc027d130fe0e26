"""Every registered query with SQL against DuckDB, on the smallest tables."""

import importlib.util
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert cols == sorted(names)
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns
