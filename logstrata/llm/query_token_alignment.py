"""op12: all documents aligned between two vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import token_alignment
from logstrata.llm.common import table
from logstrata.llm.query_fertility import vocabulary

NAME = "op12_token_alignment"
#: Token ids are beyond SQL.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
    paths = tuple(map(vocabulary, names))
    return token_alignment.align(table(spark, sf_dir, "documents"), paths)
