"""Posting lists: the same matches from fewer sentences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import grammar as G
from corpusloom.plans import postings as P

DDL = "doc_id long, sid long, features array<map<string,string>>"


def one(*codes, **graphs):
    return G.Grammar({"Main": G.sequence(*codes), **graphs})


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng, path = random.Random(7), f"file://{tmp_path_factory.mktemp('postings')}/index"
    rows = [(d, s, [{"w": rng.choice("abcdefgh") if rng.random() < 0.97 else f"rare{rng.randint(0, 9)}", "t": rng.choice("NV")} for _ in range(rng.randint(0, 9))]) for d in range(150) for s in range(4)]
    sentences = spark.createDataFrame([*rows, (999, 0, None), (999, 1, [{"w": None, "t": "N"}, None])], DDL)
    P.write_index(sentences, path)
    return path, sentences


GRAMMARS = {
    "rare": one("<+w=rare3>", "<+t=N>"), "either": one("<+w=rare1>|<+w=rare2 +t=V>"), "pattern": one("<+w=/rare[0-4]/>", "<-t=V>"), "negative": one("<-w=a>", "<-t=N>"),
    "called": one(":In", "<+t=V>", In=G.sequence("<+w=rare5>")), "unknown": one("<+w=nowhere>"), "names": one("<+/w|t/=N>", "<+w=b>"), "cross": one("=><+w=rare0>", "<+w=a>"),
    "ways": G.Grammar({"Main": G.Graph({0: G.Node("<E>", [1, 3]), 1: G.Node("<+w=rare6>", [1, 2]), 2: G.Node("<+t=N>", [5]), 3: G.Node("<+w=rare7>", [4]), 4: G.Node("<+w=/[ab]/>", [5, 0]), 5: G.Node("")}, 0, 5)}),
    "around": G.Grammar({"Main": G.Graph({0: G.Node("<+w=a>", [1]), 1: G.Node("<+w=rare8>", [2]), 2: G.Node("<+w=b>", [0, 3, 1]), 3: G.Node("")}, 0, 3)}),
    "nested": G.Grammar({"Main": G.Graph({0: G.Node("<+w=rare9>", [1, 2]), 1: G.Node(":Main", [2]), 2: G.Node("<+t=V>", [3]), 3: G.Node("")}, 0, 3)}),
}


@pytest.mark.parametrize("name", GRAMMARS)
def test_matches_are_those_of_the_whole_corpus(spark, index, name):
    path, sentences = index
    key = lambda f: sorted((r.doc_id, r.sid, r.start, r.len) for r in f.collect())
    want = key(G.match(sentences.where("features IS NOT NULL"), GRAMMARS[name]))
    assert key(P.indexed_match(spark, path, GRAMMARS[name])) == want
    assert want or name in ("unknown", "around", "nested", "rare", "called", "cross")


def test_fewer_sentences_and_folders_are_read(spark, index):
    path, sentences = index
    read = P.pruned(spark, path, GRAMMARS["rare"])
    holding = sentences.where(F.exists("features", lambda t: t["w"] == "rare3")).count()
    assert read.count() == holding < sentences.count() / 20
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"sentences\], PartitionFilters: \[[^\]]*part#", plan) and re.search(r"postings\], PartitionFilters: \[[^\]]*bucket#", plan)
    assert spark.read.parquet(f"{path}/sentences").where(F.col("part").isin([r[0] for r in P.candidates(spark, path, P.Has("w", "rare3")).select("part").distinct().collect()])).count() < sentences.count() / 2
    # Of a frequent value beside a rare one, the list is not read.
    assert P.terms_of(P.selective(spark, path, P.needs(GRAMMARS["rare"]))) == [P.Has("w", "rare3")]
    assert P.pruned(spark, path, GRAMMARS["unknown"]).count() == 0
    assert P.pruned(spark, path, GRAMMARS["negative"]).count() == sentences.count()


def test_formulas():
    assert P.needs(GRAMMARS["negative"]) == P.ANY and P.needs(one("<+w=a -t=N>|<-w=b>")) == P.ANY
    assert P.needs(GRAMMARS["either"]) == P.Either(frozenset({P.Has("w", "rare1"), P.Both(frozenset({P.Has("w", "rare2"), P.Has("t", "V")}))}))
    assert P.needs(GRAMMARS["called"]) == P.Both(frozenset({P.Has("w", "rare5"), P.Has("t", "V")}))
    with pytest.raises(G.GrammarError):
        P.needs(one(":Nowhere"))


def test_a_sentence_posts_each_value_once_without_sorting(spark, tmp_path):
    rng = random.Random(4)
    rows = [(d, k, [None if rng.random() < 0.1 else {"w": rng.choice("abc"), "k": rng.choice(["x", "y", None])} for _ in range(rng.randint(0, 8))]) for d in range(9) for k in range(20)]
    rows += [(99, 0, None), (99, 1, [{}]), (99, 2, [None]), (99, 3, [{"w": "a", "v": "a"}, {"v": "a"}])]
    P.write_index(spark.createDataFrame(rows, "doc_id long, sid long, features array<map<string,string>>"), f"{tmp_path}/index")
    got = spark.read.parquet(f"{tmp_path}/index/postings").select("attribute", "value", "doc_id", "sid").collect()
    want = {(a, v, d, k) for d, k, ts in rows for t in ts or () for a, v in (t or {}).items() if v is not None}
    assert sorted(map(tuple, got)) == sorted(want)
