"""op8: all documents judged by tokeniser fertility."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import fertility
from logstrata.llm.common import table

NAME = "op8_fertility"
#: The bands come from sketches over all documents, which SQL has not.
SQL = None
#: Folder of the vocabularies; by default that of the installed package.
FOLDER = "TOKENIZER_DIR"


def vocabulary(name: str) -> str:
    if folder := os.environ.get(FOLDER):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fertility.judge(docs, vocabulary("piece_bpe_32k.model")).drop("h1", "h2", "lang")
