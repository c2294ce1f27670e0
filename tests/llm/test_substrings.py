import hashlib
import random
import re

import pytest

from corpusloom.llm import substrings
from corpusloom.llm.queries import op10_substrings


def brute(rows, n=13):
    """doc_id (None last) and text -> words, removed, kept text, row by row."""
    split = [(i if i is not None else float("inf"), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - n + 1):
            if first[tuple(words[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (w, g, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (w, g, t) in zip(rows, brute(rows), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substrings(spark, sf_dir).collect()}
    assert got == want and any(g for _, g, _ in want.values())


@pytest.mark.parametrize("seed", range(3))
def test_patchworks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[f"{c}{i}" for i in range(60)] for c in "abcdef"]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            p, a = rng.choice(pool), rng.randint(0, 50)
            text += p[a : a + rng.randint(1, 40)]
        rows.append((rng.choice([i, i, 7, None]), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r["doc_id"]), r["words"], r["removed"], r["text"]) for r in substrings.drop_repeated_passages(docs).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows), strict=True))


def test_factors_are_drawn_out_and_cut_at_sources(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} {b} y"), (4, a + " " + b)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.drop_repeated_passages(docs).collect()}
    assert got[3]["text"] == "x y" and [tuple(s) for s in got[3]["spans"]] == [(1, 30, 1), (31, 30, 2)]
    # The phrases over the boundary are new in document 3, and old in document 4.
    assert [tuple(s) for s in got[4]["spans"]] == [(0, 30, 1), (18, 24, 3), (30, 30, 2)] and got[4]["text"] == ""


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((str(r["doc_id"]), r["words"], r["removed"], r["text"]) for r in substrings.drop_repeated_passages(odd_docs).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows), strict=True))
    assert substrings.drop_repeated_passages(no_docs).count() == 0


def test_factors_follow_one_text_of_the_source():
    at, source = substrings.np.array([5, 0, 9, 30, 31]), substrings.np.array([1, 1, 1, 1, 2])
    place = substrings.np.array([105, 100, 109, 130, 7])
    assert substrings.factors(at, source, place, 13) == [(0, 22, 1), (30, 13, 1), (31, 13, 2)]
    assert substrings.factors(at[:3], source[:3], substrings.np.array([105, 100, 110]), 13) == [(0, 18, 1), (9, 13, 1)]


def test_factors_decide_and_spare_the_index(spark):
    """Of a long copy only its boundary is looked up; the rest comes from the factor."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[50:350]) + " y")], "doc_id long, text string")
    rows = docs.select("doc_id", "text")
    held = []
    real = substrings.looked_up
    try:
        substrings.looked_up = lambda asked: held.append(asked.where("length > 0").groupBy("doc").count().collect()) or real(asked)
        got = {r["doc_id"]: r for r in substrings.drop_repeated_passages(rows).collect()}
    finally:
        substrings.looked_up = real
    assert got[2]["text"] == "x y" and [tuple(s) for s in got[2]["spans"]] == [(1, 300, 1)]
    seeds, rest = ({r["doc"]: r["count"] for r in h} for h in held)
    assert 0 < seeds[2] < 120 and rest[2] < 30 < 280 < rest[1]


def test_twenty_thousand_repeated_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long_text)] + [(2, long_text + " tail of its own")] * 20_000 + [(None, long_text)] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.drop_repeated_passages(docs).groupBy("doc_id", "words", "removed", "text").count().collect()
    assert {(r["doc_id"], r["words"], r["removed"], r["count"]) for r in got} == {(1, 120, 0, 1), (2, 124, 120, 20_000), (None, 120, 120, 2_000)}
