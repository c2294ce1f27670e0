import math

import numpy as np
import pytest

from corpusloom.llm import neighbours
from corpusloom.llm.queries import op2_neighbours


def brute(rows, asks, k=10):
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v))]
    out = {}
    for q, v in good:
        if asks(q):
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in good if i != q and len(x) == len(v))[:k]
            out[q] = [(i, s) for s, i in near]
    return out


def test_recall_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in op2_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) <= set(want)
    vectors = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and q not in dict(near)
        for i, s in near:
            assert s == pytest.approx(np.sqrt(((np.array(vectors[q]) - np.array(vectors[i])) ** 2).sum()), abs=1e-12)
    assert np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) / len(near) for q, near in want.items()]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]),
            (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.9, 0.0]), (0, [5.0, 5.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<double>, bucket string, part int")
    got = {}
    for r in neighbours.nearest(frame, frame, k=3, width=4.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[1] == [0, 10, 2] and got[2][0] in (0, 1) and 9 not in got
    assert all(set(v) <= {0, 1, 2, 10} for v in got.values())
    empty = frame.limit(0)
    assert neighbours.nearest(empty, empty).count() == 0


def test_a_hot_bucket_is_split_and_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + (0 if i % 3 else 1e-3) * rng.normal(size=8)).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in neighbours.nearest(frame, frame.where("id % 100 = 0"), width=10.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-12)))
    assert got == brute(rows, lambda i: i % 100 == 0)


def found(frame, asks, **args):
    got = {}
    for r in neighbours.nearest(frame, frame.where(asks), **args).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-9)))
    return got


def test_vectors_off_the_bulk_have_all_their_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * (1 if i % 20 else 300)).tolist()) for i in range(1, 601)] + [(1000 + i, rng.normal(size=5).tolist()) for i in range(4)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    asks = lambda i: i % 20 == 0 or i >= 1000
    assert found(frame, "id % 20 = 0 OR id >= 1000") == brute(rows, asks)


def test_the_width_is_not_that_of_copies(spark):
    rng = np.random.default_rng(6)
    copy = rng.normal(size=8)
    rows = [(i, (copy if i % 3 else rng.normal(size=8)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    assert neighbours.cell_width(frame) > 0.5 and neighbours.cell_width(frame.unionByName(frame), most=100) > 0.5
    assert neighbours.cell_width(frame.where("id % 3 <> 0")) == 1.0


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows * 12 + [(50, [3.0, 0.0, 0.0, 0.0]), (50, [-3.0, 0.0, 0.0, 0.0])], "id long, vector array<double>")
    want = brute([*rows, (50, [3.0, 0.0, 0.0, 0.0]), (50, [-3.0, 0.0, 0.0, 0.0])], lambda i: i < 5)
    for width in (50.0, None):
        assert found(frame, "id < 5", width=width) == want


def test_perturbations_come_in_order_and_are_sound():
    sets = neighbours.perturbations(6, 60)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == len(set(sets)) == 60
    assert all(11 - r not in s for s in sets for r in s)
