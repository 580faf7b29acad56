"""op11: all documents scored for toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import toxicity
from logstrata.llm.common import table

NAME = "op11_string_kernel"
#: A trained machine is beyond SQL.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
