"""Expressions in conditions and outputs."""

import pytest

from corpusloom.plans import expressions as X
from corpusloom.plans import grammar as G
from corpusloom.plans import outputs as O

DDL = "doc_id long, sid long, features array<map<string,string>>"


@pytest.mark.parametrize(("text", "want"), [
    ("n + 1", "4"), ("s + n", "ab3"), ("n * 2 - 1", "5"), ("n / 2", "1.5"), ("6 / n", "2"), ("n % 2 == 1", "true"), ("s === 'ab' && n > 2", "true"), ("!(n > 2) || s", "ab"), ("s.length", "2"),
    ("t.W + '!'", "x!"), ("missing", ""), ("missing + 1", "1"), ("s - 1", ""), ("n / 0", ""), ("'a' != \"b\"", "true"), ("s != 'ab'", "false"), ("-n", "-3"), ("1 < n <= 3", "true"), ("'&&'", "&&"), ("null", ""),
])
def test_values(text, want):
    assert X.shown(X.value(X.read(text), {"n": "3", "s": "ab", "t": {"W": "x"}})) == want


@pytest.mark.parametrize("text", ["f(1)", "a[0]", "a.b()", "lambda: 1", "2 ** 9", "x if y else z", "a =", "[1]", "b'x'", "1" * 1001, "__import__('os')", "a := 1"])
def test_what_is_refused(text):
    with pytest.raises(X.ExpressionError):
        X.read(text)
    with pytest.raises(G.GrammarError):
        G.check(G.Grammar({"Main": G.sequence(f"<+w=${text}$>")}))


def sentences(spark, *texts):
    return spark.createDataFrame([(1, i, [{"w": c, "n": str(k)} for k, c in enumerate(t)]) for i, t in enumerate(texts)], DDL)


def test_conditions_over_variables(spark):
    """A token, any number of others, the same one again."""

    def remember(sentence, at, variables):
        return {**variables, "first": sentence[at]["w"], "at": at}

    graph = G.Graph({0: G.Node("<+w=/[ab]/>", [1, 2], remember, '<PAIR +of="$first$" +next="$at + 1$"'), 1: G.Node("<-w=$first$>", [1, 2]), 2: G.Node("<+w=$first$>", [3], output=">"), 3: G.Node("")}, 0, 3)
    got = G.match(sentences(spark, "axxa", "abab", "ab", "", "bcb."), G.Grammar({"Main": graph}), traced=True)
    assert sorted((r.sid, r.start, r.len) for r in got.collect()) == [(0, 0, 4), (1, 0, 3), (4, 0, 3)]
    spans = {(r.sid, r.name): (r.start, r.end, r.features) for r in O.spans_of(got).collect()}
    assert spans[1, "PAIR"] == (0, 2, {"of": "a", "next": "1"}) and spans[4, "PAIR"] == (0, 2, {"of": "b", "next": "1"})


def test_the_tested_token_and_the_sentences_variables(spark):
    wanted = G.Grammar({"Main": G.sequence("<+n=$size - 1$>")}, init=lambda sentence: {"size": len(sentence)})
    assert sorted((r.sid, r.start) for r in G.match(sentences(spark, "abc", "x", ""), wanted).collect()) == [(0, 2), (1, 0)]
    same = G.Grammar({"Main": G.sequence("<+w=$token.n$>")})
    assert [(r.sid, r.start) for r in G.match(sentences(spark, "x12"), same).collect()] == [(0, 1), (0, 2)]
    behind = G.Grammar({"Main": G.sequence("?<=<+n=$size - 2$>", "<+w=/./>")}, init=lambda sentence: {"size": len(sentence)})
    assert [(r.sid, r.start) for r in G.match(sentences(spark, "abc"), behind).collect()] == [(0, 2)]


def test_a_filled_condition_that_is_none_holds_of_nothing(spark):
    wanted = G.Grammar({"Main": G.sequence("<+w=$w$>")}, init=lambda sentence: {"w": "<" if sentence and sentence[0]["w"] == "a" else "b"})
    assert [(r.sid, r.start) for r in G.match(sentences(spark, "a<", "xb"), wanted).collect()] == [(1, 1)]
