"""Mixing sources to target weights by entropy balancing.

Wanted are rates, as close as possible in relative entropy to taking every
document once, with which each source gives its target of words. The solution
tilts a document's rate exponentially by its words, ``rate = min(most,
exp(tilt * size / mean size of the source))``, with one dual variable, the tilt,
for each source. Newton's method finds the tilts; each iteration is one
distributed sum over the corpus. Rates are then rounded to copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import staged

#: Most copies of a document, and most words of a source as a multiple of its size.
MOST = 3
#: Documents that one task rounds together.
GROUP_ROWS = 2000
#: Words by which a source may miss its target before rounding, as a part of it.
TOLERANCE = 1e-6
ROUNDS = 60
#: Most sources whose duals are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass
class Dual:
    """The tilt of a source and the interval that holds it."""

    target: float
    words: int
    docs: int
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    def step(self, got: float, slope: float) -> None:
        """Newton's step for ``got`` words; halves the interval where it would leave it."""
        miss = got - self.target
        if abs(miss) <= TOLERANCE * self.target + 0.5:
            self.done = True
            return
        if miss > 0:
            self.high = self.tilt
        else:
            self.low = self.tilt
        new = self.tilt - miss / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low):
                new = 2 * self.high - 1
            elif math.isinf(self.high):
                new = 2 * self.low + 1
            else:
                new = (self.low + self.high) / 2
        self.done = new in (self.low, self.high)
        self.tilt = new


def words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sizes: dict[str | None, int], weight: Callable[[int], float], most: float = MOST
) -> dict[str | None, float]:
    """Words that each source shall give: shares of all words by weight.

    Sources are ordered by code point, null last; ``weight`` takes the place in
    that order. No target exceeds ``most`` times the source's words; the excess
    goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: weight(i) for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = left / sum(weights[s] for s in rest) if rest else 0.0
        over = [s for s in rest if share * weights[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, share * weights[s]) for s in order}
        fixed.update({s: float(most * sizes[s]) for s in over})


def _dual_table(df: DataFrame, duals: dict[str | None, Dual], most: float) -> DataFrame:
    """One row a source: its tilt, words, target and groups."""
    rows = [
        (s, min(d.tilt, 1e300), d.words / max(d.docs, 1), d.words, d.target,
         -(-d.docs // GROUP_ROWS))
        for s, d in duals.items()
    ]
    schema = "of string, tilt double, mean double, source_size long, target double, groups long"
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table


def _tilted(most: float) -> Column:
    power = F.when(F.col("size") > 0, F.col("tilt") * F.col("size") / F.col("mean")).otherwise(0.0)
    return F.least(F.lit(float(most)), F.exp(F.least(power, F.lit(700.0))))


def solve(counted: DataFrame, duals: dict[str | None, Dual], most: float = MOST) -> int:
    """Newton iterations over (source, size, docs); the number of them."""
    for d in duals.values():
        if d.target >= most * d.words * (1 - 1e-12):
            d.tilt, d.done = math.inf, True
    for rounds in range(ROUNDS):
        open_ = {s: d for s, d in duals.items() if not d.done}
        if not open_:
            return rounds
        rate, size = F.col("rate"), F.col("size")
        sums = (
            counted.join(_dual_table(counted, open_, most), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("rate", _tilted(most))
            .groupBy("source")
            .agg(
                F.sum(F.col("docs") * size * rate).alias("got"),
                F.sum(
                    F.when(rate < most, F.col("docs") * size * size / F.col("mean") * rate)
                ).alias("slope"),
            )
        )
        for row in sums.collect():
            duals[row["source"]].step(row["got"], row["slope"] or 0.0)
    if missed := [s for s, d in duals.items() if not d.done]:
        raise ArithmeticError(f"no solution after {ROUNDS} rounds for {missed[:5]}")
    return ROUNDS


def _copies(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def round_group(group: pd.DataFrame) -> pd.DataFrame:
        """Whole copies, longest documents first; what rounding misses is carried on."""
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last")
        carry, low, extra = 0.0, [], []
        for size, rate, docs in zip(group["size"], group["rate"], group["docs"]):
            want = docs * rate + (carry / size if size else 0.0)
            got = min(max(math.floor(want + 0.5), 0), most * docs)
            carry += (docs * rate - got) * size
            low.append(got // docs)
            extra.append(got % docs)
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"], "source": group["source"], "size": group["size"],
                "docs": group["docs"], "copies": low, "extra": extra,
            }
        )

    return round_group


def mix(
    docs: DataFrame,
    weight: Callable[[int], float] = lambda place: 1.0 + place % 3,
    most: int = MOST,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row.

    ``size`` is the words of the text (null: 0), ``taken`` the words that the
    mix takes: ``copies`` times the size, at most ``most`` times. Documents
    without words are taken once. The words taken from a source differ from its
    target by about half of one of its shortest documents for each group of
    ``GROUP_ROWS`` documents that are rounded together. Equal rows (id, source
    and size) share their copies evenly, in any order; all else depends on
    values alone, so reruns agree. An empty table gives no rows.

    The driver holds a few numbers for each source. Sums run over documents
    counted by (source, size), and a group to round has a bounded number of
    different rows, so that neither a hot source nor repeated rows meet in a task.
    """
    rounded, known = _rounded(docs, weight, most)
    each = rounded.select(
        "doc_id", "source", "size", "copies", "extra",
        F.explode(F.sequence(F.lit(1).cast("long"), "docs")).alias("nth"),
    )
    copies = F.col("copies") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return each.join(known, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _rounded(docs: DataFrame, weight, most: int) -> tuple[DataFrame, DataFrame]:
    """Copies of each different (doc_id, source, size), and the table of sources."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
    )
    rows = staged(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("docs")))
    counted = staged(rows.groupBy("source", "size").agg(F.sum("docs").alias("docs")))
    sums = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("words"), F.sum("docs").alias("docs")
    )
    found = {row["source"]: row for row in sums.collect()}
    goals = targets({s: row["words"] for s, row in found.items()}, weight, most)
    duals = {s: Dual(goals[s], found[s]["words"], found[s]["docs"]) for s in goals}
    solve(counted, duals, most)
    known = _dual_table(rows, duals, most)
    tilted = (
        rows.join(known, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", F.when(F.col("size") > 0, _tilted(most)).otherwise(1.0))
        .withColumn("part", F.expr("pmod(xxhash64(doc_id, size), groups)"))
        .select("doc_id", "source", "size", "docs", "rate", "part")
    )
    rounded = tilted.groupBy("source", "part").applyInPandas(
        _copies(most), "doc_id long, source string, size long, docs long, copies long, extra long"
    )
    return rounded, known


def repeat(
    docs: DataFrame,
    weight: Callable[[int], float] = lambda place: 1.0 + place % 3,
    most: int = MOST,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mix`` takes them.

    Rows that are equal in id, source and size and whose copies do not come out
    even are numbered by a hash of their text to tell which get one more.
    """
    rounded, _ = _rounded(docs, weight, most)
    names = ["doc_id", "source", "size"]
    given = rounded.select(*[F.col(n).alias(f"_{n}") for n in names], "docs", "copies", "extra")
    own = (F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")))
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), *[c.alias(n) for c, n in zip(own, names)])
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    found = keyed.join(given, same)
    even = found.filter(F.col("extra") == 0)
    order = Window.partitionBy(names).orderBy(F.xxhash64("row.text"))
    odd = found.filter(F.col("extra") > 0).withColumn("nth", F.row_number().over(order))
    odd = odd.withColumn("copies", F.col("copies") + (F.col("nth") <= F.col("extra")).cast("long"))
    taken = even.select("row", "copies").union(odd.select("row", "copies"))
    taken = taken.filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
