import glob
import os

import duckdb
import pytest

import corpus_pipeline
from sheetspark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.sql(queries.SQL[name])
    columns = sorted(df.columns)
    own, theirs = ([[r[list(names).index(c)] for c in columns] for r in got] for got, names in ((df.collect(), df.columns), (want.fetchall(), want.columns)))
    assert sorted(map(str, own)) == sorted(map(str, theirs))


def test_stages_keep_the_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mix", "byte_bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == names, name
        path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        assert 0 < after.count(), name
        if name == "minhash_near_dedup":
            assert after.groupBy("doc_id").count().where("count > 1").count() == 0
        at = after
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.count() == at.count() and last.where("size(ids) <> n_tokens").count() == 0
