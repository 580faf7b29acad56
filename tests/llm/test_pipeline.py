"""The stages on a small table, the contract of the queries, and their SQL."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks import compare
from logstrata.llm import registry
from logstrata.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        assert (docs.columns == columns) == (name != "pack")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert docs.filter("length > 2048 or offset + length > 2048").count() == 0


def test_stages_of_no_rows_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], schema
    )
    for docs in (spark.createDataFrame([], schema), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_names():
    names = list(contract.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    assert compare.compare(spark, SF, [name]) == []
