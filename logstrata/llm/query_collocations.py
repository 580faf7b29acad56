"""op13: phrases of two and three words, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import collocations
from logstrata.llm.common import LOWER, UPPER, table

NAME = "op13_collocations"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


SQL = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (
    SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2),
        lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(words) >= k
),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
m AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM c WHERE k >= 2 AND f >= 10
),
parts AS (
    SELECT lang, k, phrase, a, cut, array_to_string(words[1:cut], ' ') AS head,
        array_to_string(words[cut + 1:], ' ') AS tail
    FROM m, (VALUES (1), (2)) AS cuts(cut) WHERE cut < k
),
s AS (
    SELECT parts.lang, parts.k, parts.phrase, a, cut, x.f AS l, y.f AS r,
        (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts JOIN c x ON x.lang = parts.lang AND x.phrase = head
    JOIN c y ON y.lang = parts.lang AND y.phrase = tail
),
b AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS lowest FROM s) q
    WHERE lowest = 1
),
inner_pairs AS (
    SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase
    FROM m WHERE k = 3
),
longest AS (SELECT lang, phrase, max(a) AS most FROM inner_pairs GROUP BY ALL),
kept AS (
    SELECT b.* FROM b LEFT JOIN longest o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT * FROM (
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang
        ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank,
        phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
    FROM kept JOIN t ON t.lang = kept.lang) q
WHERE rank <= 2000
"""
