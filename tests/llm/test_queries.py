"""Registered queries against their SQL, and the pipeline's stages."""

import corpus_pipeline
import pytest
from compare import difference, duck

from entitynet.llm.checks_sql import CHECKS
from entitynet.llm.queries import QUERIES
from entitynet.llm.tables import read

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(CHECKS[name]).df()) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, SF)
    table = {"op3": "pages", "op9": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    key = {"pages": "page_id", "embeddings": "vec_id" if name.startswith("op13") else "query_id"}.get(table, "doc_id")
    whole = read(spark, SF, table).where("vec_id % 100 = 0" if key == "query_id" else "true").count()
    assert rows.select(key).distinct().count() == whole


def test_stages_keep_the_columns_and_run_ends_with_pieces(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
