"""The maximum-entropy model against plain Python: counts, probabilities that add up, gradients, and held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import maxent as M


def words_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]


def out_of(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    count = Counter()
    for i, t in rows:
        if not out_of(i):
            count.update([*words_of(t), None])
    n, v = sum(count.values()), len(count)
    found = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        found.append((i, out_of(i), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)))
    return found


def check(docs, **given):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(M.score(docs, **given).collect(), key=str)
    key = lambda r: (str(r[:5]), r[5])
    for g, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert g[:5] == b[:5] and g[5] == pytest.approx(b[5], abs=1e-8)
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)
    return got


def prose(rng, n):
    """Two languages: each text keeps to one."""
    words = [[f"{p}{k}en" for k in range(40)] for p in "ab"], [[f"{p}rare{k}{e}" for k in range(300)] for p, e in (("a", "ing"), ("b", "tion"))]
    rows = []
    for i in range(n):
        own = rng.randrange(2)
        rows.append((i, " ".join(rng.choice(words[0][own]) if rng.random() < 0.7 else rng.choice(words[1][own]) for _ in range(rng.randint(1, 300)))))
    return rows


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_empty_table(no_docs):
    assert M.score(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(100) if out_of(i)][:3]
    got = check(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"))
    assert {r["base_score"] for r in got} == {0.0} and {r["n_known"] for r in got} == {0}
    assert got[0]["score"] == pytest.approx(3 * math.log10(1 / M.TAIL_CLASSES))


def test_held_out_gain_and_reruns(spark):
    docs = spark.createDataFrame(prose(random.Random(4), 1200), "doc_id long, text string").repartition(2, "doc_id")
    first, second = check(docs), check(docs)
    assert first == second
    own = [r for r in first if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in own) / sum(r["n_tokens"] for r in own)
    # The language is told by the context: up to log10(2) a word.
    assert len(own) > 50 and gain > 0.12


def test_texts_with_rare_words_beyond_the_common_ones(spark, monkeypatch):
    monkeypatch.setattr(M, "COMMON", 20)
    monkeypatch.setattr(M, "CHUNK", 500)
    check(spark.createDataFrame(prose(random.Random(8), 150), "doc_id long, text string"))


def test_thousands_of_copies_and_a_long_text(spark):
    ids = [i for i in range(1000) if out_of(i)]
    rows = [(ids[0], "only held out texts say this")] * 3000 + [(3, "word other " * 60_000)] + [(None, "nobody")] * 500
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def model_of(rng, texts):
    keys = [M.keys_of(t.encode()) for t in texts]
    flat, sizes = np.concatenate(keys), np.array([len(k) for k in keys])
    found, n = np.unique(flat, return_counts=True)
    order = np.lexsort((found.view(np.int64), -n))
    tail = np.zeros(M.TAIL_CLASSES)
    for k, c in zip(found[order][M.HEAD :], n[order][M.HEAD :], strict=True):
        tail[int(k) & (M.TAIL_CLASSES - 1)] += c + 1
    return flat, sizes, M.Counts(int(n.sum()), len(n), found[order], n[order], tail + 1)


def test_probabilities_add_up_to_one():
    rng = random.Random(2)
    texts = [t for _, t in prose(rng, 60)]
    keys, sizes, counts = model_of(rng, texts)
    model = M.untrained(counts)
    e = M.events(keys, sizes, counts)
    for low in range(0, len(keys), 512):
        M.update(model, e, low, min(low + 512, len(keys)), 1.0)
    # Every known word after one context, and an unknown one in each tail class.
    context = M.keys_of(b"a1en b2en arare3ing")[:-1]
    unknown = np.arange(M.TAIL_CLASSES, dtype=np.uint64) | np.uint64(0xABCDEF << 40)
    words = np.concatenate([counts.keys, unknown])
    asked = np.concatenate([np.append(context, w) for w in words])
    place, known, score = M.partial_scores(asked, np.full(len(words), 4), model, counts)
    assert (place[3::4] >= 0).tolist() == [True] * len(counts.keys) + [False] * M.TAIL_CLASSES
    assert float((10 ** score[3::4]).sum()) == pytest.approx(1, abs=1e-4)


def test_step_follows_the_gradient():
    rng = random.Random(3)
    keys, sizes, counts = model_of(rng, [t for _, t in prose(rng, 10)])
    model = M.untrained(counts)
    e = M.events(keys, sizes, counts)

    def loss(m):
        return -float(M.log_softmax(m.outer, m.class_bias, e.rows)[np.arange(len(keys)), e.cls].sum())

    moved = model.copy()
    M.update(moved, e, 0, len(keys), 1e-3)
    step = moved.outer - model.outer
    at = np.unravel_index(np.argsort(-np.abs(step).ravel())[:20], step.shape)
    for r, c in zip(*at, strict=True):
        near = [model.copy(), model.copy()]
        near[0].outer[r, c] += 0.05
        near[1].outer[r, c] -= 0.05
        assert np.sign(loss(near[0]) - loss(near[1])) == -np.sign(step[r, c])
    assert loss(moved) < loss(model)


def test_change_vector_round_trip():
    _, _, counts = model_of(None, ["a b c a b a"])
    model = M.untrained(counts)
    model.outer[3, 4], model.outer_seen[3] = 2.5, 7.0
    other = M.untrained(counts).moved(model.flat() - M.untrained(counts).flat())
    for a, b in zip(model.parts(), other.parts(), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_lookup_with_shared_places():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64) << np.uint64(1) | np.uint64(1))
    keys = np.concatenate([keys, (np.arange(1, 40, dtype=np.uint64)) | np.uint64(1 << 60)])
    found = M.Lookup(keys)
    assert found(keys).tolist() == list(range(len(keys)))
    assert set(found(keys + np.uint64(1 << 30)).tolist()) == {-1}
    assert set(M.Lookup(keys[:0])(keys).tolist()) == {-1}


def test_only_named_columns_are_read(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "k", 2.0)], "doc_id long, text string, n long, key string, score double")
    assert M.score(docs).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert M.score(docs.withColumn("text", F.lit(None).cast("string"))).first()["n_tokens"] == 1
