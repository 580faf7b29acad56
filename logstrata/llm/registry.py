"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import (
    query_cap_filters,
    query_collocations,
    query_entropy_mix,
    query_fertility,
    query_histogram_shards,
    query_ngram_join,
    query_packing,
    query_passages,
    query_pseudonyms,
    query_token_alignment,
    query_toxicity,
    query_url_rules,
    query_warc,
)
from logstrata.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    query_warc,
    query_packing,
    query_url_rules,
    query_passages,
    query_histogram_shards,
    query_cap_filters,
    query_pseudonyms,
    query_fertility,
    query_entropy_mix,
    query_ngram_join,
    query_toxicity,
    query_token_alignment,
    query_collocations,
)


def shipped(query: Query) -> Query:
    """The query, with this package sent to the executors before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {module.NAME: shipped(module.query) for module in MODULES}
ORACLES: dict[str, str] = {module.NAME: module.SQL for module in MODULES if module.SQL}
