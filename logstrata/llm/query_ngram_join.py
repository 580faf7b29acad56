"""op10: components of near duplicates of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import ngram_join
from logstrata.llm.common import table

NAME = "op10_ngram_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


#: Candidates share one of the shingles that come first by frequency; pairs are
#: verified on whole sets, and components are walked from every document.
SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(len(words) - 4),
            lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS grams FROM w
),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
f AS (SELECT gram, count(*) AS docs FROM g GROUP BY gram),
o AS (
    SELECT doc_id, n, gram, row_number() OVER (PARTITION BY doc_id ORDER BY docs, gram) AS place
    FROM g JOIN f USING (gram)
),
p AS (SELECT doc_id, n, gram FROM o WHERE place <= n - (80 * n + 99) // 100 + 1),
c AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y USING (gram)
    WHERE x.doc_id < y.doc_id AND 80 * greatest(x.n, y.n) <= 100 * least(x.n, y.n)
),
v AS (
    SELECT a, b, len(list_intersect(x.grams, y.grams)) AS common, len(x.grams) + len(y.grams) AS total
    FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
),
e AS (
    SELECT a, b FROM v WHERE 100 * common >= 80 * (total - common)
    UNION ALL SELECT b, a FROM v WHERE 100 * common >= 80 * (total - common)
),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a
"""
