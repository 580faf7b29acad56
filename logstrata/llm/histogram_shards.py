"""Sharding by histogram sort: probe keys are counted until they split evenly.

A splitter of a shard is the largest key with at most its share of all bytes
below it. Each round counts, in every partition, the exact bytes and rows
between candidate keys; the sums show between which two candidates each
splitter lies, and the next round's candidates lie between those. Only counts
travel, until one exchange moves every row to its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.llm.common import staged

#: Candidates for each splitter that is still open, in each round.
PROBES = 64
#: Candidates of all splitters together in a round, about: counts that the driver gets.
MOST_PROBES = 1 << 20
#: Bytes that one task sorts; a shard is cut into pieces of about this size.
PIECE_BYTES = 256 << 20
_SIGN = np.int64(-(2**63))


@dataclass
class Splitter:
    """Between ``low`` (at most ``target`` bytes below it) and ``high`` (more)."""

    target: int
    tolerance: int
    low: int
    high: int
    bytes_low: int
    rows_low: int
    bytes_high: int
    rows_high: int

    def found(self) -> bool:
        return (
            self.rows_high - self.rows_low <= 1
            or self.high - self.low <= 1
            or self.bytes_high - self.bytes_low <= self.tolerance
        )

    def probes(self, count: int) -> list[int]:
        width = self.high - self.low
        return sorted({self.low + width * i // (count + 1) for i in range(1, count + 1)} - {self.low})


def packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit integers as 16 bytes each that sort as the pairs do."""
    both = np.empty((len(first), 2), ">u8")
    both[:, 0] = (first ^ _SIGN).view(np.uint64)
    both[:, 1] = (second ^ _SIGN).view(np.uint64)
    return both.reshape(-1).view("S16")


def _packed_ints(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _int(first: int, second: int) -> int:
    return ((first + 2**63) << 64) | (second + 2**63)


def _counts(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Bytes and rows from each probe (0: before the first) up to the next."""
    edges = _packed_ints(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            first, second, size = (np.asarray(c) for c in batch.columns)
            at = np.searchsorted(edges, packed(first, second), side="right")
            np.add.at(sums, at, size)
            rows += np.bincount(at, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(sums[at]), pa.array(rows[at])], ["bucket", "bytes", "rows"]
        )

    parts = keyed.select("first", "second", "size").mapInArrow(
        count, "bucket long, bytes long, rows long"
    )
    total = parts.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {row["bucket"]: (row["bytes"], row["rows"]) for row in total.collect()}


def refine(keyed: DataFrame, splitters: list[Splitter], probes: int = PROBES) -> int:
    """Narrow all splitters until they are found; the number of rounds.

    Splitters that lie between the same two keys share their probes, of which
    a round has at most about ``MOST_PROBES``.
    """
    rounds = 0
    while open_ := [s for s in splitters if not s.found()]:
        places = {(s.low, s.high): s for s in open_}
        each = max(2, min(probes, MOST_PROBES // len(places)))
        tried = sorted({k for s in places.values() for k in s.probes(each)})
        counted = _counts(keyed, tried)
        sizes, rows = (
            np.cumsum([counted.get(i, (0, 0))[part] for i in range(len(tried))], dtype=np.int64)
            for part in (0, 1)
        )
        for s in open_:
            # Probes up to ``at`` have no more than the target below them.
            at = int(np.searchsorted(sizes, s.target, side="right"))
            if at > 0 and tried[at - 1] > s.low:
                s.low, s.bytes_low, s.rows_low = tried[at - 1], int(sizes[at - 1]), int(rows[at - 1])
            if at < len(tried) and tried[at] < s.high:
                s.high, s.bytes_high, s.rows_high = tried[at], int(sizes[at]), int(rows[at])
        rounds += 1
    return rounds


def shard(
    docs: DataFrame,
    shards: int = 16,
    tolerance: float = 0.0,
    piece_bytes: int = PIECE_BYTES,
    probes: int = PROBES,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``size`` is the bytes of the text (null: none) plus 1. Rows are ordered by
    doc_id (null first); a shard is a range of that order, and ``slot`` the
    place in it. The row in which the running sum of sizes passes i/``shards``
    of the total is the first of shard i, if ``tolerance`` is 0; otherwise a
    splitter may be off by that part of a shard. Rows of equal ids are ordered
    by a hash of their text and then spread at random, so that a boundary can
    fall within any number of repeated rows. An empty table gives no rows;
    fewer rows than shards leave shards empty.

    The driver holds a few numbers for each splitter, of which there is one for
    every ``piece_bytes`` of input, and the counts of a round's probes. Texts of
    any length are a size and two hashes; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    spread = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1))
    keyed = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce("doc_id", F.lit(-(2**63))).alias("first"),
            (F.xxhash64(text).bitwiseAND(F.lit(~((1 << 24) - 1))).bitwiseOR(spread)).alias("second"),
        )
    )
    whole = keyed.agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("rows"),
        F.min("first").alias("low"),
        F.max("first").alias("high"),
    ).first()
    total = whole["bytes"] or 0
    cuts = max(1, -(-total // (shards * piece_bytes)))
    low, high = _int(whole["low"] or 0, -(2**63)), _int(whole["high"] or 0, 2**63 - 1) + 1
    splitters = [
        Splitter(
            target=total * i // (shards * cuts),
            tolerance=int(tolerance * total / shards) if i % cuts == 0 else piece_bytes // 2,
            low=low, high=high, bytes_low=0, rows_low=0, bytes_high=total, rows_high=whole["rows"],
        )
        for i in range(1, shards * cuts)
    ]
    refine(keyed, splitters, probes)
    edges = _packed_ints([s.low for s in splitters])
    before = np.array([0] + [s.rows_low for s in splitters], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (np.asarray(batch.column(c)) for c in ("first", "second"))
            piece = np.searchsorted(edges, packed(first, second), side="right")
            base = before[piece] - before[piece // cuts * cuts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(piece.astype(np.int32)), pa.array(base)],
                [*batch.schema.names, "piece", "base"],
            )

    schema = (
        "doc_id long, size long, text_crc32 long, first long, second long, piece int, base long"
    )
    within = F.row_number().over(Window.partitionBy("piece").orderBy("first", "second"))
    return keyed.mapInArrow(place, schema).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("piece") / cuts).cast("int").alias("shard"),
        (F.col("base") + within - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
