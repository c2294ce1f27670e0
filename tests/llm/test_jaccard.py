import random
import re

import pytest

from corpusloom.llm import jaccard
from corpusloom.llm.queries import op5_jaccard


def brute(rows, n=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), doc) if x is not None], default=None)
    return sorted((str(doc), len(sets[i]), str(least[root(i)])) for i, (doc, _) in enumerate(rows))


def got(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in frame.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert got(op5_jaccard(spark, sf_dir)) == want and any(d != c for d, _, c in want)


@pytest.mark.parametrize("seed", range(2))
def test_edited_copies_and_common_passages(spark, seed):
    """Chains of edits around the threshold, many texts that share a passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 30))
    passage = [word() for _ in range(20)]
    texts = []
    for _ in range(12):
        text = [word() for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 8))]) for _ in range(40)] + ["a b", "A  b", "a", "", None, " "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.jaccard_groups(docs)) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(jaccard.jaccard_groups(odd_docs)) == brute(rows)
    assert jaccard.jaccard_groups(no_docs).count() == 0
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8"])
    assert jaccard.keep_one(no_docs).count() == 0
