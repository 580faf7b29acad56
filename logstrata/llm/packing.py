"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most one sequence; full pieces are
sequences of their own. The others are dealt to blocks, and each block is packed
by several islands. A chromosome is a set of bins. Crossover injects whole
well-filled bins of one parent into the other, removes the bins there that hold
the same pieces, and best-fits the pieces that this displaces. After some
generations the elite of every island moves to the next one of its block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.common import staged
from logstrata.llm.tokens import Encoder

CAPACITY = 2048
#: Pieces that are packed together, about.
BLOCK_PIECES = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 5, 30, 4
#: Part of the bins, the fullest, of which crossover injects some.
WELL_FILLED = 0.5
#: Bins that are filled less are packed once more, with those of other blocks.
FULL = 0.98


# --- Pieces ------------------------------------------------------------------


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces; all but the first are full."""
    first = (length - 1) % capacity + 1
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, json_path: str, rank_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document.

    A document is the ids of its text (null: empty) and an id 0 at its end.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_path, rank_path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encoder.ids(text or "").astype("<u4").tobytes() + bytes(4)
                out += [
                    (doc_id, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))
                    for i, (start, n) in enumerate(cut(len(ids) // 4, capacity))
                ]
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return taken.mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# --- The genetic algorithm ----------------------------------------------------


def best_fit(lengths: np.ndarray, order: np.ndarray, genes: np.ndarray, rooms: list, next_bin: int,
             capacity: int) -> int:
    """Put pieces, in order, where the least room is left; the next free bin.

    ``rooms`` is the sorted list of (room, bin) of the open bins.
    """
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, (need, -1))
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            room, bin_ = capacity, next_bin
            next_bin += 1
        genes[i] = bin_
        if room > need:
            insort(rooms, (room - need, bin_))
    return next_bin


def fills(genes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(genes, weights=lengths).astype(np.int64)


def fitness(genes: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Mean of squared fillings: fewer and fuller bins are better."""
    filled = fills(genes, lengths)
    filled = filled[filled > 0]
    return float(((filled / capacity) ** 2).sum() / max(len(filled), 1))


def _repacked(genes, lengths, displaced, next_bin, capacity) -> np.ndarray:
    """Best-fit decreasing of the displaced pieces among the bins that remain."""
    kept = ~displaced
    filled = np.bincount(genes[kept], weights=lengths[kept], minlength=next_bin).astype(np.int64)
    used = np.flatnonzero((filled > 0) & (filled < capacity))
    rooms = sorted(zip((capacity - filled[used]).tolist(), used.tolist()))
    at = np.flatnonzero(displaced)
    best_fit(lengths, at[np.argsort(-lengths[at], kind="stable")], genes, rooms, next_bin, capacity)
    return np.unique(genes, return_inverse=True)[1]


def crossover(one, two, lengths, capacity, rng) -> np.ndarray:
    """``one`` with some of the fullest bins of ``two``."""
    filled = fills(two, lengths)
    full = np.argsort(-filled, kind="stable")[: max(1, int(WELL_FILLED * len(filled)))]
    chosen = np.zeros(len(filled), bool)
    many = max(1, int(rng.uniform(0.25, 1.0) * len(full)))
    chosen[rng.choice(full, many, replace=False)] = True
    injected = chosen[two]
    broken = np.zeros(int(one.max()) + 1, bool)
    broken[one[injected]] = True
    genes = one.copy()
    genes[injected] = two[injected] + len(broken)
    displaced = broken[one] & ~injected
    return _repacked(genes, lengths, displaced, len(broken) + len(filled), capacity)


def mutation(genes, lengths, capacity, rng) -> np.ndarray:
    """Empties the least filled bins and a few others, and packs their pieces again."""
    filled = fills(genes, lengths)
    gone = np.zeros(len(filled), bool)
    poor = np.argsort(filled, kind="stable")[: max(2, int(rng.uniform(0.02, 0.3) * len(filled)))]
    gone[poor] = True
    gone[rng.integers(0, len(filled), max(1, len(filled) // 20))] = True
    return _repacked(genes.copy(), lengths, gone[genes], len(filled), capacity)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return -(-int(lengths.sum()) // capacity)


def bins_of(genes: np.ndarray) -> int:
    return int(genes.max()) + 1 if len(genes) else 0


def first_population(lengths, capacity, rng, size: int = POPULATION) -> list[np.ndarray]:
    """Best fit in random orders, which leaves every member room to gain."""
    out = []
    for _ in range(size):
        genes = np.zeros(len(lengths), np.int64)
        best_fit(lengths, rng.permutation(len(lengths)), genes, [], 0, capacity)
        out.append(genes)
    return out


def decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing, which no result may be worse than."""
    genes = np.zeros(len(lengths), np.int64)
    best_fit(lengths, np.argsort(-lengths, kind="stable"), genes, [], 0, capacity)
    return genes


def evolve(
    population, lengths, capacity, rng, generations: int = GENERATIONS
) -> tuple[list[np.ndarray], int]:
    """The population after some generations, the best first, and how many it took.

    It stops where no bin can go any more.
    """
    scored = sorted(((fitness(g, lengths, capacity), i, g) for i, g in enumerate(population)),
                    key=lambda s: (-s[0], s[1]))
    least = least_bins(lengths, capacity)
    for generation in range(generations):
        if bins_of(scored[0][2]) <= least or len(scored) < 2:
            return [s[2] for s in scored], generation
        a, b = rng.permutation(len(scored))[:2]
        a, b = min(a, b), max(a, b)
        child = crossover(scored[b][2], scored[a][2], lengths, capacity, rng)
        if generation % 2:
            child = mutation(child, lengths, capacity, rng)
        scored[-1] = (fitness(child, lengths, capacity), len(population) + generation, child)
        scored.sort(key=lambda s: (-s[0], s[1]))
    return [s[2] for s in scored], generations


# --- Blocks and islands in Spark ------------------------------------------------

_STATE = "block long, island int, items binary, lengths binary, genes binary, run int, began int"


def _rows(block: int, island: int, items: bytes, lengths: bytes, genes: list, run: int, began: int):
    """One row with the pieces of a block, and one for each member of the population."""
    rows = [(block, island, items, lengths, None, run, began)]
    return rows + [(block, island, None, None, g.astype(np.int32).tobytes(), 0, 0) for g in genes]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int32()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)],
        ["block", "island", "items", "lengths", "genes", "run", "began"],
    )


def _read(batches: Iterator[pa.RecordBatch]):
    """Pieces, distinct members of the population, generations run and bins at the beginning."""
    items = lengths = b""
    genes: set[bytes] = set()
    run, began = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["genes"] is None:
                items, lengths = row["items"], row["lengths"]
                run.append(row["run"])
                began.append(row["began"])
            else:
                genes.add(row["genes"])
    members = [np.frombuffer(g, np.int32).astype(np.int64) for g in sorted(genes)]
    return items, lengths, members, max(run), min(began)


def _seeds(capacity: int):
    def seed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        items = np.concatenate([np.asarray(b.column("item")) for b in tables])
        lengths = np.concatenate([np.asarray(b.column("length")) for b in tables])
        order = np.lexsort((items, -lengths))
        items, lengths = items[order], lengths[order]
        block, rows = key[0].as_py(), []
        for island in range(ISLANDS):
            genes = first_population(lengths, capacity, np.random.default_rng([block, island]))
            began = min(map(bins_of, genes))
            rows += _rows(block, island, items.tobytes(), lengths.tobytes(), genes, 0, began)
        yield _batch(rows)

    return seed


def _epochs(capacity: int, epoch: int):
    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, island = key[0].as_py(), key[1].as_py()
        items, packed, genes, run, began = _read(batches)
        lengths = np.frombuffer(packed, np.int64)
        rng = np.random.default_rng([block, island, epoch])
        genes, more = evolve(genes, lengths, capacity, rng)
        rows = _rows(block, island, items, packed, genes[:POPULATION], run + more, began)
        elite = genes[0].astype(np.int32).tobytes()
        yield _batch([*rows, (block, (island + 1) % ISLANDS, None, None, elite, 0, 0)])

    return work


def _best(capacity: int):
    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, packed, population, run, began = _read(batches)
        items, lengths = np.frombuffer(items, np.int64), np.frombuffer(packed, np.int64)
        population.append(decreasing(lengths, capacity))
        place = min(
            range(len(population)),
            key=lambda i: (bins_of(population[i]), i == len(population) - 1,
                           -fitness(population[i], lengths, capacity)),
        )
        genes = population[place]
        evolved = run if place < len(population) - 1 else None
        order = np.lexsort((items, genes))
        sizes, bins = lengths[order], genes[order]
        ends = np.cumsum(sizes)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        count = np.diff(np.append(first, len(bins)))
        offset = ends - sizes - np.repeat((ends - sizes)[first], count)
        filled = fills(genes, lengths)[bins]
        sequence = np.repeat(items[order][first], count)
        yield pa.RecordBatch.from_arrays(
            [
                *map(pa.array, (items[order], sizes, sequence, offset, filled)),
                pa.array([evolved] * len(items), pa.int32()),
                pa.array([began - bins_of(genes)] * len(items), pa.int32()),
            ],
            ["item", "length", "sequence_id", "offset", "filled", "generations", "bins_saved"],
        )

    return work


def _pack_blocks(parts: DataFrame, count: int, capacity: int) -> DataFrame:
    """The pieces (item, length) with their places and what the algorithm did for their block."""
    blocks = max(1, round(count / BLOCK_PIECES))
    dealt = parts.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    state = dealt.groupBy("block").applyInArrow(_seeds(capacity), _STATE)
    for epoch in range(EPOCHS):
        state = state.groupBy("block", "island").applyInArrow(_epochs(capacity, epoch), _STATE)
    return state.groupBy("block").applyInArrow(
        _best(capacity),
        "item long, length long, sequence_id long, offset long, filled long, generations int, "
        "bins_saved int",
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) and their places.

    Adds sequence_id (a number of one of its pieces) and offset, gapless from 0
    in each sequence, and for pieces that are no sequence by themselves
    ``generations``, which the algorithm ran for their block, and ``bins_saved``
    against the best of its first population. No block has more sequences than
    best-fit decreasing gives it; where that is better than what evolved, it is
    taken, and ``generations`` is null. Rows may repeat; each is a piece of its
    own, and pieces of equal length are placed by their numbers. Blocks hold a
    bounded number of pieces, dealt by a hash of their own number, so that no
    text or source is hot. The islands of a block stop where it has the least
    possible number of sequences. What blocks leave badly filled is packed once
    more together. A text of any length is cut to pieces first. An empty table
    gives no rows.
    """
    made = ("item", "sequence_id", "offset", "generations", "bins_saved")
    numbered = staged(pieces.drop(*made).withColumn("item", F.monotonically_increasing_id()))
    parts = numbered.filter(F.col("length") < capacity).select("item", "length")
    packed = staged(_pack_blocks(parts, parts.count(), capacity))
    open_ = packed.filter(F.col("filled") < FULL * capacity)
    again = staged(_pack_blocks(open_.select("item", "length"), open_.count(), capacity))
    none = F.lit(None).cast("int")
    whole = numbered.filter(F.col("length") >= capacity).select(
        "item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        none.alias("generations"), none.alias("bins_saved"),
    )
    columns = ["item", "sequence_id", "offset", "generations", "bins_saved"]
    places = (
        packed.filter(F.col("filled") >= FULL * capacity)
        .select(columns)
        .union(again.select(columns))
        .union(whole)
    )
    return numbered.join(places, "item").drop("item")
