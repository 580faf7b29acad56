"""op5: all documents in sixteen shards of equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import histogram_shards
from logstrata.llm.common import table

NAME = "op5_histogram_shards"
SHARDS = 16


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.shard(table(spark, sf_dir, "documents"), SHARDS)



SQL = f"""
WITH RECURSIVE remainders(b, k, r) AS (
    SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END
    FROM remainders WHERE k < 8
),
crc AS (SELECT list(r ORDER BY b) AS step FROM remainders WHERE k = 8),
d AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h
    FROM documents
),
c AS (
    SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(
        list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
        lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM d, crc
),
o AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
        sum(size) OVER ()::BIGINT AS total
    FROM c
),
s AS (SELECT *, (({SHARDS} * upto + total - 1) // total - 1)::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot,
    NULL::INT AS grown_shard
FROM s
"""
