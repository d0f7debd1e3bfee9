"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables; those whose values are rounded also on larger ones."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from matchloom.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def tables(folder):
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    equal(spark, duck, DATA, name)


@pytest.mark.parametrize("name", ["unit_vectors", "recall_exact", "feed_build", "pooled_vectors", "latency_summary"])
def test_rounded_values_equal_on_larger_tables(spark, name):
    folder = DATA.parent / "sf0.01"
    equal(spark, tables(folder), folder, name)


def equal(spark, duck, folder, name):
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    ours = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    got = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert ours == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
