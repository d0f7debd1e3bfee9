"""Registered corpus queries: SQL where there is some, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert sorted(repr([r[k] for k in cols]) for r in df.collect()) == sorted(repr([r[names.index(k)] for k in cols]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    total = spark.read.parquet(str(DATA / "documents.parquet")).count()
    assert len({*df.columns}) == len(df.columns)
    # Contaminated documents are some, token counts are per line; all others have a row per document.
    n, ids = df.count(), df.select("doc_id").distinct().count()
    assert 0 < ids < total if name == "op9_decontaminate" else ids == total and (n == total or name == "op10_token_counts" and n > total)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(p.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.3 * len(before)
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
    assert docs.filter(F.col("taken") != F.col("copies") * F.col("size")).count() == 0
    assert docs.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).filter("abs(t - g) > m").count() == 0
