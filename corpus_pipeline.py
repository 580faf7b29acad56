"""From raw documents to packed sequences: five stages, each on what the last one kept.

An empty table gives an empty table in every stage. Texts may have any length,
columns other than those of documents are kept by all stages but the last, and
each stage states what it does with nulls, repeated rows and ties.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import entropy_mix, fertility, ngram_join, pseudonyms
from logstrata.llm.common import ship, staged, table
from logstrata.llm.query_fertility import vocabulary
from logstrata.llm.query_packing import packed
from logstrata.llm.query_pseudonyms import KEY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """The stage, with the application made ready for the operators before."""

    @functools.wraps(stage)
    def run_prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_prepared


@prepared
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of their language.

    Null and empty texts have no words and go; repeated rows share a verdict.
    """
    return fertility.keep(docs, vocabulary("piece_bpe_32k.model"))


@prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Of repeated rows one stays; a row with a null id counts as the largest.
    Texts without words link with nothing and all stay.
    """
    return ngram_join.representatives(docs)


@prepared
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars counts the new text.

    Null and empty texts stay as they are; equal values get equal pseudonyms.
    """
    columns = docs.columns
    found = pseudonyms.pseudonymise(docs, KEY, "_pseudonyms_")
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", chars).select(columns)


@prepared
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights 1, 2, 3 by source take them.

    A null source comes last. A document without words stays once; ties between
    equal documents are settled by a hash of their texts, and copies are rows.
    """
    return entropy_mix.repeat(docs)


@prepared
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Each row is packed on its own, also where it repeats another; null and
    empty texts are a sequence mark alone.
    """
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("private", private),
    ("mix", mix),
    ("pack", pack),
]

#: Token ids, keyed hashes and bands from sketches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
