"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and combined hash: equal for equal sets of edges."""
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")
    ).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is the smallest.

    In each round every node's larger neighbours, then its smaller ones, are
    hung on the smallest neighbour, until nothing changes; the number of rounds
    grows with the logarithm of the longest path. Every round is written to the
    shared folder. A node with many neighbours is many rows of a join with one
    row for each key, which adaptive execution splits. No edges give no rows.
    """
    edges = (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = staged(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        new = small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        new = staged(new)
        after = _state(new)
        if after == state:
            break
        edges, state = new, after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
