"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import centroids as C

SCHEMA = "id long, vector array<double>"


def brute(rows, k, rounds, dim, scale=256, seed=2):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])

    def whole(v):
        return [math.floor(x.as_integer_ratio()[0] * scale / x.as_integer_ratio()[1]) if abs(x) < 2**40 else (x.as_integer_ratio()[0] * scale) // x.as_integer_ratio()[1] for x in v]

    c = [whole(v) for _, v in sorted(kept, key=key)[:k]]
    x = [(i, whole(v)) for i, v in kept]
    if not c:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(x, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in x]
    total, each = sum(d for _, d, _ in found), [sum(d for _, d, j in found if j == m) for m in range(len(c))]
    fits = lambda v: v if v < 2**63 else None
    return [(i, j, fits(d), fits(each[j]), fits(total), ",".join(map(str, c[j]))) for i, d, j in found]


def check(spark, rows, k=5, rounds=3, dim=4):
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in C.cluster(docs, k=k, rounds=rounds, dim=dim).collect()), key=key)
    assert got == sorted(brute(rows, k, rounds, dim), key=key)
    return got


@pytest.mark.parametrize("width", [1.0, 100.0, 3e4, 5e6, 1e12, 1e30])
def test_all_magnitudes(spark, width):
    rng = random.Random(int(width))
    check(spark, [(i, [rng.uniform(-width, width) for _ in range(4)]) for i in range(120)])


def test_a_few_large_vectors_among_small_ones(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(80)]
    rows += [(100, [2.0**40, 0.0, 0.0, 1.0]), (101, [-(2.0**90), 1.0, 0.0, 0.0]), (102, [1e300, 0.0, -1e300, 0.5]), (103, [2.0**26, 2.0**26, 0.0, 0.0])]
    got = check(spark, rows, k=84, rounds=2)
    assert any(r[2] == 0 for r in got)
    assert any(r[2] is None for r in check(spark, rows, k=3, rounds=1))


def test_nulls_ties_repeated_rows_and_other_lengths(spark):
    rows = [(1, [0.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan"), 0.0, 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0, 0.0]),
            (8, [1.0] * 5), (None, [0.5, 0.0, 0.0, 0.0]), (9, [0.5, 0.0, 0.0, 0.0])] + [(10, [0.5, 0.5, 0.0, -0.0])] * 300
    check(spark, rows, k=2)
    check(spark, rows, k=1000)


def test_a_third_of_all_rows_in_one_cluster(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(2000)] + [(5000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(3000)]
    check(spark, rows, k=7, rounds=2)


def test_empty_table_and_extra_columns(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, None)]) == []
    docs = spark.createDataFrame([(1, [1.0, 2.0], 5, "x", 3.0)], f"{SCHEMA}, cluster int, kind string, distance double")
    assert [tuple(r) for r in C.cluster(docs, k=2, rounds=1, dim=2).collect()] == [(1, 0, 0, 0, 0, "256,512")]


def test_product_and_subtraction_agree_at_the_bound():
    rng = np.random.default_rng(1)
    edge = math.isqrt((C.EXACT - 1) // 64) // 2
    for top in (edge - 1, edge, edge + 1, 3 * edge):
        x, c = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (7, 64))
        x[0], c[0], x[1] = top, -top, c[1]
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        assert [[int(d) for d in row] for row in C.squared_distances(x, c)] == exact
        at, best = C.assigned(x, c)
        assert best.tolist() == [min(row) for row in exact] and at.tolist() == [row.index(min(row)) for row in exact]


def test_blocks_survive_a_round_trip():
    for top in (5, 2**15 - 1, 2**15, 2**31, 2**61, 2**80):
        x = np.array([[top, -top], [0, 1]], dtype=np.int64 if top < 2**62 else object)
        _, _, kind, data = C.pack(np.arange(2), np.ones(2, bool), x)
        assert C.unpack(kind, data, 2).tolist() == x.tolist()
