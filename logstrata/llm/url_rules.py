"""URL rules by hash lookups of host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that could be a rule: each ending
of its host at a dot with each beginning of its path that a rule can have. The
expressions meet the rules in an equi-join on the first digits of their
SHA-256; equal full digests confirm a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import ascii_lower, staged

#: Hex digits of a digest that the join compares.
PREFIX_DIGITS = 8
#: Most rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(url))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def read_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with their digests; of both verdicts, block stays.

    ``rules`` has the columns host, path and verdict. Rows with a null are no
    rules. Hosts are lower-cased; a path is compared as it is.
    """
    return (
        rules.select(ascii_lower(F.col("host")).alias("rule_host"), "path", "verdict")
        .dropna()
        .groupBy("rule_host", F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", digest(F.col("rule")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def expressions(rules: DataFrame) -> Column:
    """All host endings and path beginnings of (host, path) that ``rules`` can have.

    Host endings have at most as many labels as the longest rule. Beginnings
    end at a slash, at most as many as a rule has, or, for rules that end
    elsewhere, have one of the lengths of those paths. These bounds come from
    all rules, so no match is lost. One row of them reaches the driver: the
    lengths are bounded by the longest path.
    """
    ends = F.col("rule_path").endswith("/")
    slashes = F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))
    most = rules.agg(
        F.max(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.max(F.when(ends, slashes)).alias("slashes"),
        F.collect_set(F.when(~ends, F.length("rule_path"))).alias("lengths"),
    ).first()
    parts = F.split("host", "\\.")
    first = F.greatest(F.lit(1), F.size(parts) - (most["labels"] or 1) + 1)
    hosts = F.transform(
        F.sequence(first, F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    pieces = F.split("path", "/")
    slashes_of = F.least(F.size(pieces) - 1, F.lit(most["slashes"] or 0))
    to_slash = F.transform(
        F.when(slashes_of > 0, F.sequence(F.lit(1), slashes_of)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/")),
    )
    lengths = F.array(*map(F.lit, most["lengths"])).cast("array<int>")
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    cut = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    paths = F.array_distinct(F.concat(to_slash, cut))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The longest fitting rule decides; of equally long ones that with the longer
    host. Without one the rule is null and the verdict ``default``. A null or
    broken URL has an empty host and path, which only rules of an empty host
    could fit. Rows stay as they are: repeated and null page ids give a row each,
    an empty table none. URLs and rules may have any length; columns other than
    page_id and url are not read.

    Verdicts are made once for each distinct (host, path), with partial
    aggregation, so a host with a third of all pages is a row for each of its
    paths. The way back is a join with one row a key, which adaptive execution
    splits where a key is hot.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = staged(read_rules(rules))
    many = rules.limit(BROADCAST_RULES + 1).count() > BROADCAST_RULES
    tried = (
        pages.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(rules)).alias("expression"))
        .select("host", "path", digest(F.col("expression")).alias("tried"))
        .withColumn("prefix", F.substring("tried", 1, PREFIX_DIGITS))
    )
    known = rules if many else F.broadcast(rules)
    order = F.struct(F.length("rule"), F.length("rule_host"), "rule", "verdict")
    best = (
        tried.join(known, "prefix")
        .filter(F.col("tried") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
        .select("host", "path", "best.rule", F.col("best.verdict").alias("found"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict")
    )
