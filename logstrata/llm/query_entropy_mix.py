"""op9: all documents mixed with the weights 1, 2, 3 by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import entropy_mix
from logstrata.llm.common import table

NAME = "op9_entropy_mix"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
