"""Registered queries with SQL against DuckDB, and the pipeline's stages, over the provided tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from millwright.llm import decontam, queries, simhash, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
        if name != "tokens":
            assert docs.schema.names == before.schema.names
        assert 0 < docs.count() <= before.count()
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert toxicity.score(out["toxicity"], model).filter("__score >= 0.7").count() == 0
    rows = [tuple(r) for r in out["near_dedup"].select("doc_id", "text").collect()]
    assert all(d == c for d, _, c in simhash.brute_force(rows))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(r[5] for r in decontam.brute_force([tuple(r) for r in out["decontamination"].select("doc_id", "text").collect()], items))
    assert corpus_pipeline.run(spark, SF).count() == out["tokens"].count()
