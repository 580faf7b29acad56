"""op4: all documents without passages that an earlier one has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import passages
from logstrata.llm.common import table

NAME = "op4_passages"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated(table(spark, sf_dir, "documents"), texts=False)


SQL = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
g AS (
    SELECT doc_id, unnest(list_transform(range(len(words) - 12),
        lambda i: struct_pack(place := i + 1, gram := md5(array_to_string(words[i + 1:i + 13], ' '))))) AS s
    FROM w WHERE len(words) >= 13
),
f AS (SELECT s.gram AS gram, min(doc_id) AS first_doc FROM g GROUP BY 1),
c AS (
    SELECT DISTINCT g.doc_id, unnest(range(s.place, s.place + 13)) AS place
    FROM g JOIN f ON g.s.gram = f.gram WHERE first_doc < g.doc_id
),
u AS (
    SELECT w.doc_id, word, place FROM (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w) w
    ANTI JOIN c ON w.doc_id = c.doc_id AND w.place = c.place
),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM u GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
