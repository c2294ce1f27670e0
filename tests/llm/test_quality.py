import zlib

import numpy as np
import pytest

from corpusloom.llm import quality
from corpusloom.llm.queries import op8_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op8_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) >= 0.93
    assert np.mean([p for p, y in held if y == 1]) >= 0.98


def test_labels_of_the_held_out_fifth_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.train(docs, labels)
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    b = quality.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_dual_solution_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 500, 40) + 1000 * y).astype(np.int32) for y in [0, 1] * 50]
    labels = np.array([0, 1] * 50, dtype=float)
    ratios = quality.log_count_ratios(rows, labels)
    weights, bias = quality.dual_coordinate_descent(rows, labels, ratios)
    margins = np.array([weights[r].sum() / len(r) ** 0.5 + bias for r in rows])
    assert ((margins > 0) == (labels > 0)).all()


def test_indicators_are_distinct_and_stable():
    text = "Eins zwei drei eins zwei drei ñandú 漢字"
    a = quality.indicators(text)
    quality.indicators("something else in between")
    assert len(set(a.tolist())) == len(a) and np.array_equal(a, quality.indicators(text))
    assert len(quality.indicators("")) == len(quality.indicators(None)) == 0


def test_a_repeated_doc_id_is_one_row_of_the_sample(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    first = quality.labelled_sample(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string"), labels, 10).collect()
    texts = [(i, f"text {i}") for i in ids] + [(i, f"other {n % 7} {i}") for i in ids[:12] for n in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sample = quality.labelled_sample(docs, labels, 10).collect()
    assert len(sample) == len({r["order"] for r in sample}) == 10 and {r["order"] for r in sample} == {r["order"] for r in first}
    again = quality.labelled_sample(docs.orderBy(quality.F.desc("text")), labels, 10).collect()
    assert sorted(map(str, again)) == sorted(map(str, sample))


@pytest.mark.parametrize("which", ["none", "one class", "nulls"])
def test_odd_labels(spark, odd_docs, no_docs, which):
    rows = {"none": [], "one class": [(1, 1), (2, 1), (6, 1)], "nulls": [(None, 1), (1, None), (2, 0), (2, 0), (6, 1), (7, 0), (8, 1)]}[which]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    scored = quality.score(odd_docs, model).collect()
    assert len(scored) == 10 and all(0 <= r["qc_score"] <= 1 for r in scored)
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0


def test_dual_and_primal_values_meet():
    """The solver against the definition: at the optimum of a convex problem the dual value equals the primal one."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12) + 25 * y).astype(np.int32) for y in rng.integers(0, 2, 80)]
    labels = np.array([float(r.max() > 62) for r in rows])
    ratios = quality.log_count_ratios(rows, labels)
    scaled, bias = quality.dual_coordinate_descent(rows, labels, ratios, epochs=4000)
    x = np.zeros((len(rows), 86))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / len(r) ** 0.5
    x = np.hstack([x, np.ones((len(rows), 1))])
    y, share = np.where(labels > 0, 1.0, -1.0), np.array([(labels == 0).mean(), (labels == 1).mean()])
    costs = 0.5 / share[labels.astype(int)]

    def value(w):
        return 0.5 * w @ w + (costs * np.maximum(0, 1 - y * (x @ w))).sum()

    own = np.append(np.divide(scaled[:86], ratios[:86], out=np.zeros(86), where=ratios[:86] != 0), bias)
    # A plain subgradient descent from zero, and the best value it meets, as a second solver.
    w, best = np.zeros(87), np.inf
    for t in range(1, 20_001):
        broken = y * (x @ w) < 1
        w = w - (w - x.T @ (costs * y * broken)) / t
        best = min(best, value(w))
    assert value(own) <= best * 1.002 and value(own) >= 0.98 * best


def test_long_texts_stay_within_the_bound_of_indicators(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}" for a in "abcdefghij" for b in range(4000)])
    rows = [(i, " ".join(rng.choice(words, 20_000)) + (" good" if i % 2 else " bad")) for i in range(60)] + [(100 + i, "good short one" if i % 2 else "bad short one") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels)
    sizes = sorted((r["order"], len(r["columns"])) for r in sample.collect())
    most = sum(n for _, n in sizes[: len(sizes) // 2])
    staged = quality.stage(sample)
    kept = quality.within(staged, most).collect()
    assert sorted(r["order"] for r in kept) == [o for o, _ in sizes[: len(sizes) // 2]] and sum(len(r["columns"]) for r in kept) == most
    assert quality.within(staged, 0).collect() == []
    # No row fits: a constant score, as without labels.
    assert not quality.train(docs, labels, max_values=0).weights.any()
    assert quality.train(docs, labels, max_values=most).weights.any()
