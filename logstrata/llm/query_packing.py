"""op2: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import packing
from logstrata.llm.common import table
from logstrata.llm.query_fertility import vocabulary

NAME = "op2_packing"
#: Token ids are beyond SQL.
SQL = None


def packed(docs: DataFrame) -> DataFrame:
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    return packing.pack(packing.pieces(docs, *paths))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
