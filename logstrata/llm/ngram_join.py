"""Near duplicates: an exact Jaccard join with adaptive multi-match prefixes.

A document is the set of its five-word shingles, in one order for all: rare
ones first, by a count sketch over the corpus. Two sets of at least the wanted
similarity share at least l of their first ``n - t + l`` shingles, t being the
overlap that a set of n needs. A longer prefix costs more rows but asks for more
shared ones, so each document takes the l that its estimated candidates make
cheapest. Pairs with enough shared shingles are verified on their whole sets.

What holds for l holds for one shared shingle too: only the shortest prefixes
are joined, and of the smaller set only the part that a partner of its size or
more asks for. The longer prefixes then sort out sets that share too little with
all others together, and pairs that share too little with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm import words as W
from logstrata.llm.common import sized, staged, text_hashes, without
from logstrata.llm.components import components

#: Words of a shingle, and the least similarity in percent.
LENGTH, PERCENT = 5, 80
#: Cells of the count sketch: four bytes each in a task, one byte each in the broadcast.
CELLS = 1 << 20
BLOCKS = 64
#: Partial sketches are added up in this many groups for each block first.
SALTS = 8
#: A prefix needs 1 + n // BASE matches at least; adaptive ones some times that.
BASE = 16
STEPS = (1, 2, 3)
#: Cost of verifying a candidate, in rows of prefixes.
VERIFY_COST = 8.0
#: Bits of a set's parity sketch.
PARITY_BITS = 256
#: Rounds in which each set is compared with one other before all pairs are.
STAR_ROUNDS = 1


def shingles(text: bytes | None, hashes: W.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(W.gram_hashes(hashes.of(found), min(LENGTH, len(found))))


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(11)) & np.uint64(CELLS - 1)


def _partial_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, salt = W.WordHashes(), np.zeros(CELLS, np.int32), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            grams = shingles(text, hashes)
            if len(grams):
                np.add.at(counts, _cells(grams), 1)
                salt = int(grams[0])
    parts = counts.reshape(BLOCKS, -1)
    for block in range(BLOCKS):
        if parts[block].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([salt % SALTS], pa.int32()), pa.array([parts[block].tobytes()])],
                ["block", "salt", "counts"],
            )


def _added(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // BLOCKS, np.int64)
    for batch in batches:
        for part in batch.column("counts").to_pylist():
            total += np.frombuffer(part, np.int32)
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["block", "counts"]
    )


def sketch(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle in each cell, as rounded logarithms.

    Over all documents. Its size is fixed: four bytes a cell for a task and for
    the driver, one byte a cell for the broadcast, whatever the input.
    """
    partial = docs.select(F.col("text").cast("binary")).mapInArrow(
        _partial_sketch, "block int, salt int, counts binary"
    )
    schema = "block int, counts binary"
    total = partial.groupBy("block", "salt").applyInArrow(_added, schema)
    total = total.groupBy("block").applyInArrow(_added, schema)
    counts = np.zeros((BLOCKS, CELLS // BLOCKS), np.float64)
    for row in total.collect():
        counts[row["block"]] = np.frombuffer(row["counts"], np.int32)
    counts = np.maximum(counts.ravel() - counts.mean(), 1.0)
    return np.round(4 * np.log2(counts)).astype(np.uint8)


def parity(grams: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of some bits, in 64-bit integers.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    at = ((grams >> np.uint64(32)) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=PARITY_BITS) & 1).view(np.int64)


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set similar to it."""
    return -(-PERCENT * n // 100)


def prefix(grams: np.ndarray, level: np.ndarray) -> tuple[int, np.ndarray]:
    """The matches that a set asks for, and its first shingles that can give them."""
    n = len(grams)
    order = np.lexsort((grams, level))
    need = least_overlap(n)
    weights = np.cumsum(np.exp2(level[order] / 4.0) - 1.0)
    best, chosen = np.inf, 1
    for step in STEPS:
        asked = min(step * (1 + n // BASE), need)
        size = n - need + asked
        cost = size + VERIFY_COST * weights[size - 1] / asked
        if cost < best:
            best, chosen = cost, asked
    return chosen, grams[order[: n - need + chosen]]


def _sets(level_of):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = W.WordHashes(), level_of.value
        for batch in batches:
            n, one, two, asked, firsts, odd = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, hashes)
                n.append(len(grams))
                one.append(int(grams.sum(dtype=np.uint64)) if len(grams) else 0)
                two.append(int(W.mixed(grams ^ np.uint64(77)).sum(dtype=np.uint64)) if len(grams) else 0)
                level = levels[_cells(grams)] if len(grams) else np.zeros(0, np.uint8)
                got = prefix(grams, level) if len(grams) else (0, grams)
                asked.append(got[0])
                firsts.append(got[1].view(np.int64))
                odd.append(parity(grams))
            rows = [pa.array(x, pa.uint64()).view(pa.int64()) for x in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("h1"), batch.column("h2"),
                    pa.array(n, pa.int64()), *rows, pa.array(asked, pa.int64()),
                    pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())),
                ],
                ["doc_id", "h1", "h2", "n", "one", "two", "asked", "tokens", "parity"],
            )

    return make


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes and two hashes of the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *text_hashes(),
        F.col("text").cast("binary").alias("text"),
    )


_SET = ["n", "one", "two"]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = W.WordHashes()
    for batch in batches:
        grams = [shingles(text, hashes).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(grams, pa.list_(pa.int64()))], ["id", "grams"]
        )


def _fits(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar."""
    one, two = (
        classes.select(F.col("id").alias(c), F.struct("n", "parity").alias(f"of_{c}")) for c in "ab"
    )
    pairs = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    pairs = staged(pairs.filter(_may_link("of_a", "of_b")).select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))).distinct()
    wanted = classes.join(ids, "id", "left_semi")
    keys = sized(wanted.select("id", "at.h1", "at.h2", F.col("at.doc_id").alias("of")))
    texts = _keyed(docs).join(keys, ["h1", "h2"]).filter(F.col("doc_id").eqNullSafe(F.col("of")))
    sets = texts.select("id", "text").mapInArrow(_whole, "id long, grams array<long>")
    sets = staged(sets.groupBy("id").agg(F.first("grams").alias("grams")))
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    return staged(
        pairs.join(one, "a").join(two, "b").filter(100 * both >= PERCENT * union).select("a", "b")
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of tokens that more than one set has."""
    sets = F.count("*").over(Window.partitionBy("token"))
    return rows.withColumn("sets", sets).filter(F.col("sets") > 1).drop("sets")


def _pruned(rows: DataFrame) -> DataFrame:
    """Rows of sets that have as many shared tokens as any partner asks for.

    A partner of a set of n has at least ``least_overlap(n)`` shingles, so that
    the smaller of both numbers of matches is at least the one for that size.
    """
    least = _least(F.col("n"))
    enough = 1 + F.floor(least / BASE)
    have = rows.groupBy("id", "n").agg(F.count("*").alias("have"))
    kept = have.filter(F.col("have") >= F.least(enough, least)).select("id")
    return rows.join(kept, "id")


def _least(n: Column) -> Column:
    """``least_overlap`` as a column."""
    return F.floor((PERCENT * n + 99) / 100)


def _least_with_larger(n: Column) -> Column:
    """Shingles that a set of n shares with any similar one of n or more."""
    return F.floor((2 * PERCENT * n + 99 + PERCENT) / (100 + PERCENT))


def _with_groups(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return rows.withColumn("grp", F.col("id"))
    found = components(edges).select(F.col("node").alias("id"), F.col("root").alias("grp"))
    return rows.join(found, "id", "left").withColumn("grp", F.coalesce("grp", "id"))


def _may_link(x: str, y: str) -> Column:
    """Whether sketches allow sets (structs with n and parity) to be similar."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    overlap = F.floor((PERCENT * (n + m) + 99 + PERCENT) / (100 + PERCENT))
    apart = sum(
        F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i]))
        for i in range(PARITY_BITS // 64)
    )
    return _fits(n, m) & (apart <= n + m - 2 * overlap)


def _best_pairs(met: DataFrame) -> DataFrame:
    """For each set the other one that it met most often, as a pair."""
    counts = met.groupBy("id", "other").agg(F.count("*").alias("shared"))
    best = counts.groupBy("id").agg(F.max(F.struct("shared", "other")).alias("best"))
    return best.select(
        F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")
    )


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each set with one of another group: what leads, or comes before it in, its lists.

    First are the sets with the fewest rarer shingles of their own before the
    token: they are the most like all others.
    """
    if turn % 2:
        order = Window.partitionBy("token").orderBy("at", F.xxhash64("id", F.lit(turn)))
        before = F.lag(F.struct("id", "n", "grp")).over(order)
        met = rows.withColumn("lead", before).filter(F.col("lead").isNotNull())
    else:
        lead = rows.groupBy("token").agg(
            F.min(F.struct("at", F.xxhash64("id", F.lit(turn)), "id", "n", "grp")).alias("lead")
        )
        met = rows.join(lead, "token")
    met = met.filter((F.col("grp") != F.col("lead.grp")) & _fits(F.col("n"), F.col("lead.n")))
    return _best_pairs(met.select("id", F.col("lead.id").alias("other")))


def _all_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different groups that share a token early and enough tokens in all.

    In each token's list the largest group stays on one side, so that its
    members never meet each other.
    """
    early = rows.filter(F.col("at") <= F.col("n") - _least(F.col("n")))
    early = early.withColumn("first", F.col("at") <= F.col("n") - _least_with_larger(F.col("n")))
    by_group = early.groupBy("token", "grp").agg(F.count("*").alias("members"))
    largest = by_group.groupBy("token").agg(
        F.max(F.struct("members", "grp")).alias("most"), F.count("*").alias("groups")
    )
    largest = largest.filter(F.col("groups") > 1).select("token", F.col("most.grp").alias("major"))
    marked = early.join(largest, "token").join(classes.select("id", "parity"), "id")
    marked = staged(marked)
    left = marked.filter(F.col("grp") != F.col("major")).alias("x")
    smaller = F.when(F.col("x.n") < F.col("y.n"), F.col("x.first"))
    smaller = smaller.when(F.col("x.n") > F.col("y.n"), F.col("y.first"))
    smaller = smaller.otherwise(F.col("x.first") & F.col("y.first"))
    met = left.join(marked.alias("y"), F.col("x.token") == F.col("y.token")).filter(
        (F.col("x.grp") != F.col("y.grp"))
        & ((F.col("y.grp") == F.col("y.major")) | (F.col("x.id") < F.col("y.id")))
        & smaller
        & _may_link("x", "y")
    )
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    pairs = pairs.distinct()
    lists = rows.groupBy("id").agg(
        F.first("asked").alias("asked"), F.collect_list("token").alias("tokens")
    )
    one = lists.select(F.col("id").alias("a"), F.col("asked").alias("p"), F.col("tokens").alias("s"))
    two = lists.select(F.col("id").alias("b"), F.col("asked").alias("q"), F.col("tokens").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return pairs.join(one, "a").join(two, "b").filter(shared >= F.least("p", "q")).select("a", "b")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join's three tables: documents, classes of equal sets, links.

    documents: doc_id and its class (n, one, two); classes: id, n, one, two, the
    smallest doc_id and where its text is found; links: pairs (a, b) of class
    ids that are similar and that connect all similar classes. Links between
    classes that others connect already may be left out.

    Copies are one class from the start. A group of near copies is first
    compared with one of its members, in rounds; only classes that are then not
    yet connected are compared with each other.
    """
    keyed = _keyed(docs)
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs))
    sets = staged(
        keyed.mapInArrow(
            _sets(levels),
            "doc_id long, h1 long, h2 long, n long, one long, two long, asked long, "
            "tokens array<long>, parity array<long>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    classes = staged(
        sets.groupBy(*_SET)
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct("h1", "h2", "doc_id", "row")).alias("at"),
            F.first("parity").alias("parity"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    firsts = sized(classes.filter(F.col("n") > 0).select("id", "at.row"))
    rows = sets.join(firsts, "row").select(
        "id", "n", "asked", F.posexplode("tokens").alias("at", "token")
    )
    rows = _shared(staged(_pruned(_shared(rows))))
    rows = staged(_pruned(rows))
    edges = None
    for turn in range(STAR_ROUNDS):
        found = verified(docs, classes, _star_pairs(_with_groups(rows, edges), turn))
        edges = found if edges is None else edges.union(found)
    found = verified(docs, classes, _all_pairs(staged(_with_groups(rows, edges)), classes))
    return sets.select("doc_id", "h1", "h2", *_SET), classes, edges.union(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and the group's root of every row of ``docs``.

    Two documents link when their sets of five-word shingles have a Jaccard
    similarity of at least 80 percent; component_id is the smallest doc_id that
    links lead to. A text of fewer words is one shingle. Null, empty and blank
    texts have none and link with nothing. Repeated rows link with each other.
    Null ids are never the smallest, unless there is no other: then null. Texts
    of any length are compared as whole sets, an empty table gives no rows, and
    other columns are not read.
    """
    documents, classes, edges = join(docs)
    roots = components(edges).select(F.col("node").alias("id"), "root")
    ids = classes.filter(F.col("n") > 0).join(roots, "id", "left")
    ids = ids.withColumn("root", F.coalesce("root", "id"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = ids.join(least, "root").select(*_SET, "component_id", "root")
    linked = documents.join(known, _SET, "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "h1", "h2", "root"
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns.

    That of the smallest doc_id stays (null is the largest; of several texts
    with this id the one of the smallest hash). Rows without words all stay. Of
    rows with equal id and text, one stays, whichever it is.
    """
    key = ["doc_id", "h1", "h2"]
    found = staged(near_duplicates(docs).filter(F.col("root").isNotNull()))
    keys = staged(found.groupBy("root", *key).agg(F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull(), *key)
    first = keys.groupBy("root").agg(F.min(order).alias("first"))
    both = keys.join(first, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    stays = stays & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    marked = staged(both.select(*key, "rows", stays.alias("stays")))
    named = {f"_{name}_": F.col(name) for name in key}
    columns, names = docs.columns, list(named)
    hashed = dict(zip(names, (F.col("doc_id").cast("long"), *text_hashes())))
    keyed = docs.withColumns(hashed)
    gone = marked.filter(~F.col("stays") | (F.col("rows") > 1)).select(
        [column.alias(name) for name, column in named.items()]
    )
    single = without(keyed, gone, names).select(columns)
    again = sized(
        marked.filter(F.col("stays") & (F.col("rows") > 1)).select(
            [column.alias(f"of{name}") for name, column in named.items()]
        )
    )
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"of{name}"))
    several = keyed.join(again, same, "left_semi").dropDuplicates(names).select(columns)
    return single.union(several)
