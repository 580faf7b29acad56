"""Entropy balancing: targets, the optimum, and rounding."""

import math

import numpy as np
import pytest

from logstrata.llm import entropy_mix as em

SCHEMA = "doc_id long, text string, source string, size long, target double, docs long, rate double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0, 0, 0.0) for r in rows], SCHEMA)


def documents(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s, count in (("a", 500), ("b", 60), ("c", 12), (None, 30), ("é", 40)):
        rows += [(len(rows) + i, "w " * int(rng.lognormal(3, 1)), s) for i in range(count)]
    return rows + [(9000, None, "a"), (9001, "", "b"), (None, "x y z", "a"), (9002, " \n", "z")]


def test_targets():
    got = em.targets({"a": 100, None: 10, "b": 50}, lambda place: 1.0 + place % 3)
    assert got[None] == 30 and math.isclose(got["a"], 130 / 3) and math.isclose(got["b"], 260 / 3)
    assert em.targets({}, lambda place: 1.0) == {}
    assert em.targets({"a": 0, "b": 5}, lambda place: 1.0) == {"a": 0.0, "b": 5.0}


def test_tilts_solve_the_dual(spark):
    rows = [(s, n, 1 + n % 4) for s in ("a", "b") for n in (0, 1, 5, 40, 300, 5000)]
    counted = spark.createDataFrame(rows, "source string, size long, docs long")
    words = sum(n * d for s, n, d in rows if s == "a")
    docs = sum(d for s, n, d in rows if s == "a")
    for share in (0.0, 0.01, 0.4, 1.0, 1.7, 2.9, 2.9999, 3.0):
        duals = {s: em.Dual(share * words, words, docs) for s in ("a", "b")}
        em.solve(counted, duals)
        tilt = duals["a"].tilt
        mean = words / docs
        got = sum(
            n * d * min(3.0, math.exp(min(700.0, tilt * n / mean) if n else 0.0))
            for s, n, d in rows if s == "a"
        )
        assert abs(got - share * words) <= 1e-6 * share * words + 1


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = documents()
    df = frame(spark, rows)
    got = em.mix(df).collect()
    assert len(got) == len(rows)
    for source in {r[2] for r in rows}:
        own = [r for r in got if r["source"] == source]
        size = sum(r["size"] for r in own)
        assert own[0]["source_size"] == size
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(3, 0.01 * size)
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in got)
    again = em.mix(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_repeated_rows_and_repeat(spark):
    rows = documents() + [(7777, "one two three four", "a")] * 400 + [(7778, "one two", "b")] * 3
    df = frame(spark, rows)
    mixed = em.mix(df).collect()
    taken = em.repeat(df)
    assert taken.columns == df.columns
    want, have = {}, {}
    for r in mixed:
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["copies"]
    for r in taken.collect():
        have[r["doc_id"], r["source"]] = have.get((r["doc_id"], r["source"]), 0) + 1
    assert {k: v for k, v in want.items() if v} == have


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "a")]])
def test_tables_without_words(spark, rows):
    assert [r["taken"] for r in em.mix(frame(spark, rows)).collect()] == [0] * len(rows)
    assert em.repeat(frame(spark, rows)).count() == len(rows)
