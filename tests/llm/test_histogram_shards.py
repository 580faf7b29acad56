"""Histogram sort beside a running sum."""

import zlib

import pytest

from logstrata.llm import histogram_shards as hs

SCHEMA = "doc_id long, text string, shard int, size long, first long"


def brute(rows, shards):
    """Shards by the running sum of sizes in the order of ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    total, upto, out, slots = sum(len((t or "").encode()) + 1 for _, t in rows), 0, [], {}
    for i, text in order:
        size = len((text or "").encode()) + 1
        upto += size
        shard = -(-shards * upto // total) - 1
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, zlib.crc32((text or "").encode()), "bytes", shard, slots[shard], None))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return [tuple(r) for r in hs.shard(df, **options).collect()]


@pytest.mark.parametrize("piece", [1 << 28, 300])
def test_same_as_running_sum(spark, piece):
    rows = [(i * i * 7919 % 100_003 - 50_000, "é" * (i % 37)) for i in range(400)]
    rows += [(None, "null id"), (2**63 - 1, None), (-(2**63) + 1, "x" * 5000), (11, "")]
    got = run(spark, rows, shards=7, piece_bytes=piece)
    assert sorted(got, key=repr) == sorted(brute(rows, 7), key=repr)


def test_repeated_rows_are_split(spark):
    rows = [(5, "same text")] * 1000 + [(6, "other")] * 3
    got = run(spark, rows, shards=4, piece_bytes=2000)
    sizes = [sum(r[1] for r in got if r[4] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 30
    for s in range(4):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sum(r[4] == s for r in got)))


def test_tolerance_few_rows_and_none(spark):
    rows = [(i, "x" * 99) for i in range(1000)]
    got = run(spark, rows, shards=4, tolerance=0.05)
    sizes = [sum(r[1] for r in got if r[4] == s) for s in range(4)]
    assert all(abs(size - 25_000) <= 2500 for size in sizes)
    assert len(run(spark, rows[:2], shards=16)) == 2
    assert run(spark, []) == []


def test_many_splitters_share_few_probes(spark, monkeypatch):
    """Hundreds of pieces are found with a few dozen candidates a round."""
    monkeypatch.setattr(hs, "MOST_PROBES", 40)
    rows = [(i * 7919 % 100_003, "x" * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = hs.shard(docs, 8, 0.0, piece_bytes=300).collect()
    want = hs.shard(docs, 8, 0.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
