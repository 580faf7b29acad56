"""op3: judge all pages by the given rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import url_rules
from logstrata.llm.common import table

NAME = "op3_url_rules"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)

SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
),
best AS (
    SELECT host, path, arg_max(rule_host || rule_path,
            length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
        arg_max(verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
    FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""
