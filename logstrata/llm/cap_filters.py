"""Near duplicates of embeddings by spherical-cap filters.

Directions are products of codes: a vector is cut into two blocks, and each
block has random orthonormal bases with both signs. The product of a direction
of either block is a filter, and a vector belongs to all filters whose score
with it exceeds a threshold. List decoding finds them without trying all: a
direction is followed only if the best one of the other block can make up for
it. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import staged
from logstrata.llm.components import components

THRESHOLD = 0.98
#: Filters of a vector, on average and at least.
FILTERS, LEAST_FILTERS = 16, 8
#: Vectors that a filter has on average, if there are enough directions.
BUCKET = 16
#: Directions of a block, at least and at most; with the most there are 2^26 filters,
#: beyond which buckets grow and are compared in more blocks, as exactly.
FEWEST, MOST = 128, 8192
#: Scores of directions that are held at once, for as many vectors as have them.
SCORES = 1 << 21
#: Vectors of a bucket that are compared at once; larger buckets are cut into
#: parts of half as many, and every two parts meet in a task.
BLOCK = 2048
#: Most large buckets whose keys are broadcast.
BROADCAST_BUCKETS = 100_000
SEED = 20240101


def valid(embedding: Column) -> Column:
    """Whether a vector has a direction: finite numbers only, not all zero."""
    number = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(number & some, F.lit(False))


def directions_for(vectors: int) -> int:
    """Directions of a block, so that buckets have about ``BUCKET`` vectors."""
    wanted = math.sqrt(vectors * FILTERS / BUCKET)
    return int(min(max(FEWEST, 2 ** math.ceil(math.log2(max(wanted, 1)))), MOST))


class Codes:
    """The product code for vectors of one length."""

    def __init__(self, dim: int, directions: int):
        rng = np.random.default_rng([SEED, dim])
        self.blocks = np.array_split(np.arange(dim), 2) if dim > 1 else [np.arange(dim)] * 2
        self.codes = []
        for block in self.blocks:
            bases = -(-directions // (2 * len(block)))
            parts = [
                np.linalg.qr(rng.standard_normal((len(block), len(block))))[0] for _ in range(bases)
            ]
            half = np.concatenate(parts, axis=1)
            self.codes.append(np.concatenate([half, -half], axis=1))
        count = self.codes[0].shape[1] * self.codes[1].shape[1]
        high = NormalDist().inv_cdf(1 - min(FILTERS / count, 0.5))
        self.threshold = high * math.sqrt(2 / dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each row of ``unit``."""
        one, two = (unit[:, b] @ c for b, c in zip(self.blocks, self.codes))
        width = two.shape[1]
        r1, r2 = (min(LEAST_FILTERS, s.shape[1]) for s in (one, two))
        top1 = -np.partition(-one, r1 - 1, axis=1)[:, :r1]
        top2 = -np.partition(-two, r2 - 1, axis=1)[:, :r2]
        sums = np.sort((top1[:, :, None] + top2[:, None, :]).reshape(len(unit), -1), axis=1)
        reached = sums[:, -min(LEAST_FILTERS, sums.shape[1])]
        least = np.minimum(self.threshold, reached)
        max1, max2 = top1.max(axis=1), top2.max(axis=1)
        out = []
        for s1, s2, t, m1, m2 in zip(one, two, least, max1, max2):
            a, b = np.flatnonzero(s1 >= t - m2 - 1e-12), np.flatnonzero(s2 >= t - m1 - 1e-12)
            i, j = np.nonzero(s1[a][:, None] + s2[b][None, :] >= t - 1e-12)
            out.append(np.sort(a[i] * width + b[j]))
        return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, whatever their size."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


_BUCKETED = "label long, dim int, filter long, id long, copies long, unit binary, filters binary"


def _filters(directions: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in batches:
            rows: list[tuple] = []
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            label, ids, copies = (batch.column(c).to_pylist() for c in ("label", "id", "copies"))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit = units(np.array([vectors[i] for i in at], np.float64))
                if dim not in codes:
                    codes[dim] = Codes(dim, directions)
                step = max(1, SCORES // directions)
                parts = (codes[dim].decode(unit[k : k + step]) for k in range(0, len(unit), step))
                for i, u, found in zip(at.tolist(), unit, chain.from_iterable(parts)):
                    own = u.tobytes(), found.astype(np.int64).tobytes()
                    rows += [(label[i], dim, f, ids[i], copies[i], *own) for f in found.tolist()]
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["label", "dim", "filter", "id", "copies", "unit", "filters"],
            )

    return work


def _linked(rows: list[dict], threshold: float):
    """Ids, linked copies and local roots of the vectors of one bucket that link.

    A pair counts in the smallest filter that both vectors have, and in a large
    bucket where their two parts meet.
    """
    unit = np.frombuffer(b"".join(r["unit"] for r in rows), np.float64).reshape(len(rows), -1)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    part = np.array([r["part"] for r in rows])
    if rows[0]["one"] != rows[0]["two"]:
        near &= part[:, None] != part[None, :]
    if not near.any():
        return None
    used = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(used, used)]
    lists = [np.frombuffer(rows[i]["filters"], np.int64) for i in used]
    earlier = [f[f < rows[0]["filter"]] for f in lists]
    flat = np.concatenate(earlier)
    if len(flat):
        columns, at = np.unique(flat, return_inverse=True)
        has = np.zeros((len(used), len(columns)), np.float32)
        has[np.repeat(np.arange(len(used)), [len(e) for e in earlier]), at] = 1
        counted = near & (has @ has.T == 0)
    else:
        counted = near
    copies = np.array([rows[i]["copies"] for i in used], np.int64)
    ids = np.array([rows[i]["id"] for i in used], np.int64)
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    return ids, counted @ copies, root


def _compare(threshold: float):
    keys = ("label", "dim", "filter", "one", "two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(rows):
            if len(rows) > 1 and (got := _linked(rows, threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["id", "links", "root"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    yield from flush(held)
                    held = []
                held.append(row)
        yield from flush(held)

    return work


def _parted(bucketed: DataFrame, block: int) -> DataFrame:
    """Rows with the two parts that meet; in buckets of up to ``block`` rows all do."""
    key = ["label", "dim", "filter"]
    counts = bucketed.groupBy(key).agg(F.count("*").alias("n"))
    shared = counts.filter(F.col("n") > 1)
    large = staged(
        counts.filter(F.col("n") > block).select(*key, F.ceil(2 * F.col("n") / block).cast("int").alias("parts"))
    )
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    rows = bucketed.join(shared.select(key), key).join(large, key, "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("part", part.cast("int"))
    others = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumn("one", F.least("part", "other"))
    return rows.withColumn("two", F.greatest("part", "other")).drop("other", "parts")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors``.

    Rows link when their labels are equal and the cosine of their embeddings is
    at least ``threshold``, as far as both are in a common filter; tests measure
    how many are. Equal embeddings always link. Null labels, and vectors that are
    null, empty, zero or have null or non-finite numbers, link with nothing;
    vectors of different lengths neither. component_id is the smallest vec_id
    that links lead to; rows with a null id may link, but are never the smallest
    unless there is no other.

    An empty table gives no rows, repeated rows a row each, and other columns are
    not read. Equal vectors are one class with a number of copies, so that ties
    make no difference. Buckets of any size are
    compared in blocks; a task gives sums and a root for each vector, not pairs.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("fit", valid(F.col("embedding")) & F.col("label").isNotNull())
    key = ["label", "embedding"]
    classes = staged(
        rows.filter("fit")
        .groupBy(key)
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    directions = directions_for(classes.count())
    bucketed = classes.select("label", "embedding", "id", "copies").mapInArrow(
        _filters(directions), _BUCKETED
    )
    meeting = _parted(staged(bucketed), block)
    order = ["label", "dim", "filter", "one", "two"]
    found = staged(
        meeting.repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_compare(threshold), "id long, links long, root long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "root").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.filter("fit").join(known, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("fit")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone)
