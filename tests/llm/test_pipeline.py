"""The pipeline's stages on the smallest tables, and the queries of this package against their SQL."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from check_oracle import canonical
from evenlend.llm import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_license_places_match_sql(spark, duck):
    got = catalog.QUERIES["op1_licenses"](spark, SMALL).toPandas()
    want = duck.execute(catalog.LICENSE_BASE_SQL).df()
    assert canonical(got[list(want.columns)]) == canonical(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096
