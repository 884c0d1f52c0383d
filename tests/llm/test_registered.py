"""The registered queries on the smallest tables, and the SQL where there is some."""

import duckdb
import pytest

import corpus_pipeline
from compliance_scan.llm.queries import ORACLE, QUERIES

SF0001 = "/root/testdata/sf0.001"


def test_one_query_for_every_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = QUERIES[name](spark, SF0001)
    found = con.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(con.execute(ORACLE[name]).fetchall())


def test_pipeline_stages_keep_the_columns_and_narrow_the_rows(spark, tmp_path):
    last = corpus_pipeline.run(spark, SF0001, str(tmp_path / "out"))
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    made = [spark.read.parquet(f"{tmp_path}/out/{name}") for name, _ in corpus_pipeline.STAGES]
    assert all(d.columns == docs.columns for d in made[:-1])
    counts = [docs.count(), *(d.count() for d in made)]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] == last.count()
