"""Spherical-cap filters beside all pairs."""

import math

import numpy as np
import pytest

from logstrata.llm import cap_filters

SCHEMA = "vec_id long, embedding array<float>, label int, id long, root long"


def rows_of(count, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count // 8, 32))
    rows = []
    for i in range(count):
        noise = rng.standard_normal(32) * spread * rng.uniform(0, 4)
        rows.append((i, (centres[i % len(centres)] + noise).astype(np.float32).tolist(), i % 3))
    return rows


def links(rows):
    """Linked pairs of row numbers, by the cosines of all pairs."""
    out = set()
    ok = [
        v is not None and lab is not None and len(v) > 0
        and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
        for _, v, lab in rows
    ]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    out |= {(i, j), (j, i)}
    return out


def expected(rows):
    near, comp = links(rows), list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    out = []
    for i, row in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if comp[k] == comp[i] and r[0] is not None]
        out.append((row[0], sum(a == i for a, _ in near), min(ids) if ids else None))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in cap_filters.near_duplicates(df, **options).collect()), key=repr)


def test_recall_is_whole_and_odd_rows_stay_alone(spark):
    rows = rows_of(240)
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0)]
    rows += [(504, [0.0] * 32, 0), (505, [float("nan")] * 32, 0), (506, [None] * 32, 0), (507, [], 0)]
    rows += [(508, [2.0], 0), (509, [3.0], 0), (510, [-1.0], 0), (None, rows[0][1], 0)]
    rows += [(511, [x * 1e30 for x in rows[1][1]], 1), (500, rows[0][1], 0)]
    assert run(spark, rows) == sorted(expected(rows), key=repr)


def test_large_buckets_in_blocks(spark):
    rows = rows_of(160, seed=4, spread=0.02)
    assert run(spark, rows, block=8) == sorted(expected(rows), key=repr)


def test_list_decoding_is_complete():
    code = cap_filters.Codes(32, 128)
    unit = cap_filters.units(np.random.default_rng(1).standard_normal((50, 32)))
    one, two = (unit[:, b] @ c for b, c in zip(code.blocks, code.codes))
    for i, found in enumerate(code.decode(unit)):
        scores = (one[i][:, None] + two[i][None, :]).ravel()
        least = min(code.threshold, np.sort(scores)[-cap_filters.LEAST_FILTERS])
        assert set(found.tolist()) == set(np.flatnonzero(scores >= least - 1e-12).tolist())


@pytest.mark.parametrize("directions", [128, 512, 2048, 8192])
@pytest.mark.parametrize("dim", [32, 64, 256])
def test_recall_of_pairs_by_number_of_directions(directions, dim):
    """Planted pairs from the threshold on nearly always share a filter."""
    rng = np.random.default_rng([directions, dim])
    code = cap_filters.Codes(dim, directions)
    count = 120 if directions > 2048 else 300
    for cosine in (0.98, 0.985, 0.99):
        one = cap_filters.units(rng.standard_normal((count, dim)))
        other = rng.standard_normal((count, dim))
        other = cap_filters.units(other - (other * one).sum(axis=1, keepdims=True) * one)
        two = cosine * one + math.sqrt(1 - cosine**2) * other
        met = [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(code.decode(one), code.decode(two))]
        assert np.mean(met) >= 0.95


def test_empty_table(spark):
    assert cap_filters.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
