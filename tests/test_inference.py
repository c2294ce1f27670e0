import itertools
import random
from collections import Counter, defaultdict

import pytest

from corpusloom.plans import grammar as G
from corpusloom.plans import inference as I

KEYS = "keys array<string>"


def frame(spark, texts):
    return spark.createDataFrame([(list(t) if t is not None else None,) for t in texts], KEYS)


def tagged(spark, *texts):
    return spark.createDataFrame([(1, i, [{"w": c} for c in t]) for i, t in enumerate(texts)], "doc_id long, sid long, features array<map<string,string>>")


def whole(spark, grammar, texts):
    """The texts that the grammar matches from end to end, by the matcher."""
    found = {(r.sid, r.start, r.len) for r in G.match(tagged(spark, *texts), grammar).collect()}
    return {t for i, t in enumerate(texts) if (i, 0, len(t)) in found}


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_prefix_tree(spark):
    texts = random_texts(1, 60) + ["", None]
    want, ends = Counter(), Counter(t for t in texts if t)
    for t in filter(None, texts):
        want.update(t[:k] for k in range(len(t) + 1))
    got = {"".join(r.prefix): (r.depth, r.n, r.ends) for r in I.prefix_tree(frame(spark, texts)).collect()}
    assert got == {p: (len(p), n, ends[p]) for p, n in want.items()}


def test_states_are_sets_of_rests(spark):
    texts = set(random_texts(2, 60))
    rests = defaultdict(set)
    for t in texts:
        for k in range(len(t) + 1):
            rests[t[:k]].add(t[k:])
    got = {"".join(r.prefix): (r.state, r.ends) for r in I.states(frame(spark, list(texts) * 2)).collect()}
    assert got.keys() == rests.keys()
    for a, b in itertools.combinations(rests, 2):
        assert (got[a][0] == got[b][0]) == (rests[a] == rests[b])
    assert all(got[p][1] == ("" in rests[p]) for p in rests)


@pytest.mark.parametrize("seed", [3, 4])
def test_without_joining_it_accepts_the_examples_only(spark, seed):
    texts = set(random_texts(seed, 15))
    every = ["".join(t) for n in range(1, 5) for t in itertools.product("abc", repeat=n)]
    rows = [tuple(r) for r in I.automaton(frame(spark, texts)).collect()]
    found = I.Inferred(rows)
    top = found.merged([])
    got = I.accepts(frame(spark, every), sorted(found.edges(top)), [0], sorted(top[n] for n in found.finals))
    assert {"".join(r[0]) for r in got.collect()} == texts


def test_joined_nodes_generalise_and_negatives_bound_them(spark):
    texts = ["dn", "dan", "daan", "daaan"]
    every = [*texts, "daaaaaan", "n", "d", "da", "nd"]
    assert whole(spark, I.infer(frame(spark, texts), "w", similarity=None), every) == set(texts)
    loose = I.infer(frame(spark, texts), "w", similarity=0.0)
    assert whole(spark, loose, every) == {*texts, "daaaaaan"}
    held = I.infer(frame(spark, texts), "w", frame(spark, ["daaaaaan", "dn"]), similarity=0.0)
    assert whole(spark, held, every) == set(texts)
    assert G.load(G.save(loose)).graphs["Main"].nodes.keys() == loose.graphs["Main"].nodes.keys()


def test_similarity(spark):
    rows = [(1, "a", "after", "x"), (1, "a", "before", "y"), (2, "a", "after", "x"), (2, "a", "before", "z"), (3, "b", "after", "x"), (4, "a", "after", I.END), (5, "a", "after", I.END), (5, "a", "before", "y")]
    got = {(r.a, r.b): r.similarity for r in I.similar_nodes(spark.createDataFrame(rows * 2, "node long, key string, side string, neighbour string")).collect()}
    assert got == {(1, 2): 0.0, (1, 5): pytest.approx(4 / 3 - 1), (4, 5): pytest.approx(4 / 3 - 1)}


def test_signs_in_keys_and_odd_inputs(spark):
    odd = ["a b", "<", "=", "/x", "@", "+", "-", "|", "ț", "\\"]
    grammar = I.infer(spark.createDataFrame([([k, "z"],) for k in odd], KEYS), "w")
    s = spark.createDataFrame([(1, i, [{"w": k}, {"w": "z"}]) for i, k in enumerate([*odd, "c"])], "doc_id long, sid long, features array<map<string,string>>")
    assert sorted(r.sid for r in G.match(s, grammar).collect()) == list(range(len(odd)))
    with pytest.raises(G.GrammarError):
        I.infer(frame(spark, ["", None]), "w")
    with pytest.raises(G.GrammarError):
        I.infer(frame(spark, ["abc"]), "w", most=2)


def test_bootstrap(spark):
    texts = ["dnvdan", "vdaan", "dnv", "nvn", "daav"]
    gold = [(1, 0, 0, 1), (1, 0, 3, 5), (1, 1, 1, 4), (1, 2, 0, 1)]
    gold = spark.createDataFrame(gold, "doc_id long, sid long, start int, `end` int")
    _, found = I.bootstrap(tagged(spark, *texts), gold, "w")
    assert sorted(map(tuple, found.select("doc_id", "sid", "start", "end").collect())) == sorted(map(tuple, gold.collect()))


def test_compared(spark):
    ddl = "doc_id long, sid long, start int, `end` int"
    gold = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 5, 6)], ddl)
    found = spark.createDataFrame([(1, 0, 1, 3), (1, 0, 5, 5), (1, 1, 0, 0)], ddl)
    extra, missed, wrong = I.compared(found, gold)
    assert sorted((r.sid, r.tid) for r in extra.collect()) == [(0, 3), (1, 0)]
    assert sorted((r.sid, r.tid) for r in missed.collect()) == [(0, 0), (0, 6)]
    assert sorted((r.sid, r.start, r.end) for r in wrong.collect()) == [(0, 1, 3), (1, 0, 0)]
