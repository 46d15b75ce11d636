"""The registered queries on the smallest tables, against SQL where there is some, and the pipeline stage by stage."""

import os

import duckdb
import pytest

from looploom.llm import queries
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        rel = con.sql(queries.ORACLE_SQL[name])
        assert got == rows(rel.columns, rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p
    from looploom.llm.quality import quality_rules
    from looploom.llm.simhash import simhash_components
    from looploom.tables import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, kept = docs, {}
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == start.columns
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert kept["quality rules"] == sorted(r["doc_id"] for r in quality_rules(start).where("kept").collect())
    comps = simhash_components(start.join(spark.createDataFrame([(i,) for i in kept["toxicity"]], "doc_id long"), "doc_id"))
    assert kept["simhash near-dedup"] == sorted({r["component_id"] for r in comps.collect()})
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["mixing"])
    empty = start.where("false")
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
