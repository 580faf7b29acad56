"""Near duplicates beside a brute-force version."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logstrata.llm import ngram_join as nj
from logstrata.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id string"


def grams_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    """(doc_id, n, component) of each row, by comparing all pairs."""
    sets = [grams_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if find(k) == find(i) and r[0] is not None]
        out.append((row[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else row[0]))
    return sorted(out, key=repr)


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"common{i}" for i in range(60)]
    out = []
    for base in range(12):
        words = list(rng.choice(vocabulary, rng.integers(30, 200)))
        out.append(" ".join(words))
        for changes in (1, 1, 2, 4, 9):
            copy = list(words)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    for extra in (1, 3, 6, 9, 12, 15, 20):
        out += [" ".join(passage + list(rng.choice(vocabulary, extra))) for _ in range(6)]
    return out


def test_same_components_as_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (501, rows[3][1].upper())]
    rows += [(None, rows[3][1]), (None, "only one here and nowhere else at all"), (502, None)]
    rows += [(503, ""), (504, " \n\t "), (505, "a b"), (506, "A\nB"), (507, "a  b c"), (508, "a b")]
    rows = [(*r, "en", "s", 1, 9, "clash") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nj.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    kept = nj.representatives(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    linked = [r for r in brute(rows) if r[1] > 0]
    blank = [r for r in brute(rows) if r[1] == 0]
    assert len(ids) == len({r[2] for r in linked}) + len(blank)


def test_many_near_copies_and_a_long_text(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        copy = list(base)
        copy[int(rng.integers(0, 80))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(900, " ".join(f"long{i}" for i in range(60_000)))]
    rows += [(901, " ".join(f"long{i}" for i in range(60_300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nj.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    found = {r[0]: r[2] for r in got}
    assert [found[i] for i in range(120)] == [r[2] for r in sorted(brute(rows[:120]))]
    assert found[901] == 900


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).count() == 0
    assert nj.representatives(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 12), max_size=40))
def test_prefixes_keep_all_pairs(left, right):
    """Similar sets share as many early shingles as either asks for."""
    hashes = W.WordHashes()
    sets = [nj.shingles(b" ".join(b"%d" % w for w in words), hashes) for words in (left, right)]
    if not all(len(s) for s in sets):
        return
    common = len(np.intersect1d(*sets))
    if 100 * common < 80 * len(np.union1d(*sets)):
        return
    level = [(s % np.uint64(7)).astype(np.uint8) for s in sets]
    asked, firsts = zip(*(nj.prefix(s, v) for s, v in zip(sets, level)))
    assert len(np.intersect1d(*firsts)) >= min(asked)
    bits = sum(int(x).bit_count() for x in
               (nj.parity(sets[0]).view(np.uint64) ^ nj.parity(sets[1]).view(np.uint64)))
    assert bits <= len(sets[0]) + len(sets[1]) - 2 * common


@pytest.mark.parametrize("n", [1, 2, 5, 9, 80, 1001])
def test_least_overlaps(spark, n):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        nj._least(F.lit(n)).alias("a"), nj._least_with_larger(F.lit(n)).alias("b")
    ).first()
    assert row["a"] == nj.least_overlap(n) == -(-80 * n // 100)
    assert row["b"] == -(-160 * n // 180)
