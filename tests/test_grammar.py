import random

import pytest

from corpusloom.operators import predicates
from corpusloom.plans import grammar as G
from pyspark.sql import functions as F

DDL = "doc_id long, sid long, features array<map<string,string>>"


def sentences(spark, *texts):
    return spark.createDataFrame([(1, i, [{"w": c} for c in t]) for i, t in enumerate(texts)], DDL)


def found(frame):
    return sorted((r.sid, r.start, r.len) for r in frame.collect())


def one(*codes, **graphs):
    return G.Grammar({"Main": G.sequence(*codes), **graphs})


@pytest.mark.parametrize("force", [False, True])
def test_leftmost_without_overlap_and_priority(spark, force):
    s = sentences(spark, "AAAA", "AB")
    assert found(G.match(s, one("<+w=A>", "<+w=A>"), force_matcher=force)) == [(0, 0, 2), (0, 2, 2)]
    short_first = G.Grammar({"Main": G.Graph({0: G.Node("<E>", [1, 2]), 1: G.Node("<+w=A>", [4]), 2: G.Node("<+w=A>", [3]), 3: G.Node("<+w=B>", [4]), 4: G.Node("")}, 0, 4)})
    assert found(G.match(s.where("sid = 1"), short_first, force_matcher=force)) == [(1, 0, 1)]


def test_limit(spark):
    loop = G.Grammar({"Main": G.Graph({0: G.Node("<+w=A>", [0, 1]), 1: G.Node("")}, 0, 1)})
    assert found(G.match(sentences(spark, "AAAA"), loop)) == [(0, 0, 4)]
    assert found(G.match(sentences(spark, "AAAA"), loop, limit=2)) == [(0, 0, 2), (0, 2, 2)]


def test_recursion_uses_the_matcher(spark):
    nested = G.Graph({0: G.Node("<+w=(>", [1, 2]), 1: G.Node(":Main", [2]), 2: G.Node("<+w=)>", [3]), 3: G.Node("")}, 0, 3)
    assert found(G.match(sentences(spark, "(())x()", "(("), G.Grammar({"Main": nested}))) == [(0, 0, 4), (0, 5, 2)]


@pytest.mark.parametrize("force", [False, True])
def test_look_around(spark, force):
    s = sentences(spark, "ABAC")
    assert found(G.match(s, one("<+w=A>", "?=<+w=B>"), force_matcher=force)) == [(0, 0, 1)]
    assert found(G.match(s, one("<+w=A>", "?!<+w=B>"), force_matcher=force)) == [(0, 2, 1)]
    assert found(G.match(s, one("?<=<+w=A>", "<+w=/./>"), force_matcher=force)) == [(0, 1, 1), (0, 3, 1)]
    assert found(G.match(s, one("?<!<+w=/./>", "<+w=/./>"), force_matcher=force)) == [(0, 0, 1)]


def test_static_checks():
    with pytest.raises(G.EmptyMatchError):
        G.check(one("<E>"))
    with pytest.raises(G.InfiniteLoopError):
        G.check(G.Grammar({"Main": G.Graph({0: G.Node("<+w=A>", [1]), 1: G.Node("<E>", [2, 3]), 2: G.Node("<E>", [1]), 3: G.Node("")}, 0, 3)}))
    with pytest.raises(G.UnknownGraphError):
        G.check(one(":Nowhere"))
    with pytest.raises(ValueError):
        predicates.parse_clauses("<+a>")


def test_random_grammars_agree_on_both_paths(spark):
    rng = random.Random(8)
    s = sentences(spark, *("".join(rng.choice("AB") for _ in range(rng.randint(0, 9))) for _ in range(40)))
    for _ in range(8):
        n = rng.randint(3, 5)
        nodes = {k: G.Node(rng.choice(["<+w=A>", "<+w=B>", "<+w=A>|<+w=B>", "?=<+w=A>", "<E>"]), rng.sample(range(k + 1, n + 1), rng.randint(1, min(2, n - k)))) for k in range(n)} | {n: G.Node("")}
        for k in range(n):
            if nodes[k].code.startswith("<+") and rng.random() < 0.4:
                nodes[k].children.insert(rng.choice([0, len(nodes[k].children)]), k)
        g = G.Grammar({"Main": G.Graph(nodes, 0, n)})
        try:
            G.check(g)
        except G.GrammarError:
            continue
        assert G.to_regex(g, G.clauses_of(g)) is not None
        assert found(G.match(s, g)) == found(G.match(s, g, force_matcher=True))


def test_xml_round_trip():
    g = G.Grammar({"Main": G.sequence("<+w=@m@>")}, {"m": "A"})
    again = G.load(G.save(g))
    assert again.macros == {"m": "A"} and again.graphs["Main"].nodes[1].code == "<+w=@m@>" and again.graphs["Main"].end == 2


@pytest.mark.parametrize(("code", "want"), [
    ("<+x=1>", False), ("<-x=1>", True), ("<+a=v>", True), ("<+a=/V/>", False), ("<+a=/V/i>", True), ("<+a=/v/ -b=/.*/>", False), ("<+/a|z/=/./>", True), ("<-/q/=/./>", True), ("<+q=1>|<+b=2>", True),
])
def test_conditions(spark, code, want):
    row = spark.createDataFrame([({"a": "v", "b": "2"},)], "f map<string,string>")
    assert row.select(predicates.condition(code, F.col("f"))).first()[0] is want


def test_whole_match_is_anchored(spark):
    row = spark.createDataFrame([({"a": "ab\n"},)], "f map<string,string>")
    assert row.select(predicates.condition("<+a=/ab/>", F.col("f"))).first()[0] is False


def test_long_matches_need_no_recursion(spark):
    loop = G.Grammar({"Main": G.Graph({0: G.Node("<+w=A>", [0, 1]), 1: G.Node("")}, 0, 1)})
    s = spark.createDataFrame([(1, 0, ["A"] * 20_000)], "doc_id long, sid long, forms array<string>")
    assert found(G.match(s, loop, "forms", force_matcher=True, of=lambda w: {"w": w})) == [(0, 0, 20_000)]


def test_left_recursion_is_refused(spark):
    left = G.Graph({0: G.Node("<E>", [1, 2]), 1: G.Node(":Main", [2]), 2: G.Node("<+w=A>", [3]), 3: G.Node("")}, 0, 3)
    with pytest.raises(G.LeftRecursionError):
        G.check(G.Grammar({"Main": left}))
    with pytest.raises(G.LeftRecursionError):
        G.check(G.Grammar({"Main": G.sequence(":A", "<+w=A>"), "A": G.sequence("?=<+w=A>", ":B", "<+w=A>"), "B": G.sequence(":A", "<+w=B>")}))


def test_a_node_that_leads_nowhere_accepts(spark):
    dead = G.Grammar({"Main": G.Graph({0: G.Node("<+w=A>", [1, 2]), 1: G.Node("<+w=B>", [3]), 2: G.Node("<+w=C>"), 3: G.Node("")}, 0, 3)})
    assert found(G.match(sentences(spark, "ABACA"), dead)) == [(0, 0, 2), (0, 2, 2)]


@pytest.mark.parametrize("force", [False, True])
def test_anchored_matches(spark, force):
    s = sentences(spark, "AAB", "AB", "BA").withColumn("at", F.lit(1)).withColumn("more", F.col("sid") * 10)
    got = G.match(s, one("<+w=A>", "<+w=B>"), force_matcher=force, anchor="at", keep=("more",)).collect()
    assert [(r.sid, r.more, r.start, r.len) for r in got] == [(0, 0, 1, 2)]
    assert found(G.match(s, one("?<=<+w=A>", "<+w=B>"), force_matcher=force, anchor="at")) == [(1, 1, 1)]


def test_output_code(spark):
    matches = G.match(sentences(spark, "xAB"), one("<+w=A>", "<+w=B>"))
    got = G.annotated(matches, '<NP +kind="short" +size="n$len$">').collect()
    assert [(r["name"], r["start"], r["end"], r["features"]) for r in got] == [("NP", 1, 2, {"kind": "short", "size": "n2"})]
    for bad in ("<NP", "NP +a=b", '<NP -a>'):
        with pytest.raises(G.GrammarError):
            G.annotated(matches, bad)


def test_cross_references_and_graphs_in_assertions(spark):
    s = sentences(spark, "ABAC", "AC", "")
    assert found(G.match(s, one("=><+w=B>", "<+w=A>"))) == [(0, 0, 1), (0, 2, 1)]
    assert found(G.match(s, one("!=><+w=B>", "<+w=A>"))) == [(1, 0, 1)]
    # Out of the sentence only a negative one holds.
    assert found(G.match(s, one("<+w=C>", "=><+w=A>"))) == []
    assert found(G.match(s, one("<+w=C>", "!=><+w=A>"))) == [(0, 3, 1), (1, 1, 1)]
    pair = G.sequence("<+w=A>", "<+w=C>")
    for force in (False, True):
        assert found(G.match(s, one("?=:Pair", "<+w=/./>", Pair=pair), force_matcher=force)) == [(0, 2, 1), (1, 0, 1)]
        assert found(G.match(s, one("?!:Pair", "<+w=A>", Pair=pair), force_matcher=force)) == [(0, 0, 1)]
    back = G.sequence("<+w=A>", "<+w=B>")
    assert found(G.match(s, one("?<=:Back", "<+w=/./>", Back=back))) == [(0, 2, 1)]
    assert found(G.match(s, one("?<!:Back", "<+w=A>", Back=back))) == [(0, 0, 1), (1, 0, 1)]
    assert found(G.match(s, one("=>:Pair", "<+w=B>", Pair=pair))) == [(0, 1, 1)]
    # Backwards through a call, a loop at the first node, and an assertion.
    loop = G.Graph({0: G.Node("<+w=A>", [0, 1]), 1: G.Node(":One", [2]), 2: G.Node("")}, 0, 2)
    t = sentences(spark, "AABC", "BC", "AAC")
    assert found(G.match(t, one("?<=:Loop", "<+w=C>", Loop=loop, One=G.sequence("?=<+w=B>", "<+w=B>")))) == [(0, 3, 1)]
    with pytest.raises(G.LeftRecursionError):
        G.check(one("?=:Again", "<+w=A>", Again=G.sequence("<+w=A>", ":Main")))


def test_spans_as_symbols(spark):
    s = sentences(spark, "ABCAB", "AB")
    spans = spark.createDataFrame(
        [(1, 0, "NP", 0, 1, {"k": "x"}), (1, 0, "NP", 0, 2, {"k": "y"}), (1, 0, "NP", 3, 4, {"k": "x"}), (1, 0, "VP", 3, 3, None)],
        "doc_id long, sid long, name string, start int, `end` int, features map<string,string>",
    )
    held = G.with_spans(s, spans)
    run = lambda *codes: found(G.match(held, one(*codes), spans="spans"))
    assert run("<NP>") == [(0, 0, 3), (0, 3, 2)]
    assert run("<NP +k=x>") == [(0, 0, 2), (0, 3, 2)]
    assert run("<NP +k=x>", "<+w=C>") == [(0, 0, 3)]
    assert run("<NP>", "<NP>") == [(0, 0, 5)]
    assert run("<VP>", "<+w=B>") == [(0, 3, 2)]
    assert run("?<=<NP>", "<+w=A>") == [(0, 3, 1)]
    assert run("=><VP>", "<+w=C>") == [(0, 2, 1)]
    assert run("<ZP>|<+w=C>") == [(0, 2, 1)]
    with pytest.raises(G.GrammarError):
        G.match(s, one("<NP>"))


def test_guards_variables_and_arguments(spark):
    s = sentences(spark, "AAB", "ABAB", "B", "")

    def remember(sentence, at, variables):
        return {**variables, "first": sentence[at]["w"], "n": int(variables["n"]) + 1}

    def differs(sentence, at, variables):
        return sentence[at]["w"] != variables["first"]

    two = G.Grammar({"Main": G.sequence("<+w=/./>", "<+w=/./>")}, init=lambda sentence: {"n": len(sentence)})
    two.graphs["Main"].nodes[1].guard, two.graphs["Main"].nodes[2].guard = remember, differs
    got = G.match(s, two)
    assert found(got) == [(0, 1, 2), (1, 0, 2), (1, 2, 2)]
    assert {(r.sid, r.start): r.variables for r in got.collect()}[0, 1] == {"first": "A", "n": "4"}
    spans = G.annotated(got, '<Pair +of="$first$$len$" +none="$absent$">').where("sid = 0").first()
    assert spans.features == {"of": "A2", "none": ""}
    # A path that is turned back leaves no variables behind: the first child sets one and fails on its second token.
    graph = G.Graph({0: G.Node("<E>", [1, 3]), 1: G.Node("<+w=A>", [2], lambda s, k, v: {**v, "way": "one"}), 2: G.Node("<+w=B>", [4]), 3: G.Node("<+w=A>", [4]), 4: G.Node("")}, 0, 4)
    ways = {(r.sid, r.start): (r.len, r.variables) for r in G.match(s, G.Grammar({"Main": graph})).collect()}
    assert ways == {(0, 0): (1, {}), (0, 1): (2, {"way": "one"}), (1, 0): (2, {"way": "one"}), (1, 2): (2, {"way": "one"})}
    # Arguments hold in the called graph only.
    only = G.sequence("<+w=/./>")
    only.nodes[1].guard = lambda sentence, at, variables: sentence[at]["w"] == variables["want"] and {**variables, "saw": variables["want"]}
    called = G.match(s, G.Grammar({"Main": G.sequence(":Only(want=A)", ":Only(want=B)"), "Only": only}))
    assert sorted((r.sid, r.start, tuple(r.variables.items())) for r in called.collect()) == [(0, 1, (("saw", "B"),)), (1, 0, (("saw", "B"),)), (1, 2, (("saw", "B"),))]
