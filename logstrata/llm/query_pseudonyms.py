"""op7: all documents with pseudonyms for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import pseudonyms
from logstrata.llm.common import table

NAME = "op7_pseudonyms"
#: For the checks; a real key is a secret of those who hold the data.
KEY = "a public key for checks"
#: Keyed hash rounds are beyond SQL.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymise(docs, KEY)
    return found.withColumn("n_pseudonyms", F.size("pseudonyms"))
