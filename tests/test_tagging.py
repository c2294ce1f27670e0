import random

import pytest

from corpusloom.functions import tags
from corpusloom.operators import corpus, lexicon, tagging
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("tag", "language", "said"),
    [
        ("Vmip3s", "en", {"Mood": "indicative", "Number": "singular", "POS": "VERB", "Person": "third", "Tense": "present", "Type": "predicative"}),
        ("Vmip3s----y", "ro", {"Clitic": "da", "Mod": "indicativ", "Număr": "singular", "POS": "Verb", "Persoana": "a treia", "Timp": "prezent", "Tip": "predicativ"}),
        ("Afpmsvy", "en", {"Caz": "vocative", "Definiteness": "yes", "Gender": "masculine", "Number": "singular", "POS": "ADJECTIVE"}),
        ("I", "ro", {"POS": "Interjecție"}), ("COMMA", "en", {}), ("Zc", "en", {}), ("", "en", {}),
    ],
)
def test_described(spark, tag, language, said):
    found = spark.createDataFrame([(tag,)], "t string").select(F.map_entries(tags.described(F.col("t"), language)).alias("m")).first().m
    assert [tuple(e) for e in found] == sorted({"MSD": tag, **said}.items())


def test_described_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tags.described(F.col("t")).alias("m")).first().m is None


TOKENS = "sid int, tokens array<struct<form:string,in_dict:boolean,candidates:array<struct<msd:string,lemma:string>>>>"


def test_rules_go_left_to_right_and_never_empty_a_token(spark):
    both = [("Nc", "x"), ("Vm", "x")]
    rows = [(0, [("a", True, both), ("b", True, both), ("c", True, both), ("d", True, [("Vm", "x")])]), (1, []), (2, None)]
    rules = [tagging.Rule(("<+WORD=a>",), 0, "Nc"), tagging.Rule(("<-msd1=Vm>", "<+/msd./=Vm>"), 1, "V.*", keep=False)]
    left = {r.sid: r.tokens for r in tagging.ruled(spark.createDataFrame(rows, TOKENS), rules).collect()}
    assert [[c.msd for c in t.candidates] for t in left[0]] == [["Nc"], ["Nc"], ["Nc"], ["Vm"]]
    assert left[1] == [] and left[2] is None


def test_model_learns_keeps_to_candidates_and_survives_a_file(spark, tmp_path):
    words = [("runs", "V"), ("walks", "V"), ("talked", "V"), ("walked", "V"), ("Rome", "N"), ("Paris", "N"), ("London", "N"), ("Berlin", "N")]
    rows = spark.createDataFrame([(1, i, 0, w, t) for i, (w, t) in enumerate(words * 3)], "doc_id long, sid long, tid int, form string, tag string")
    around = corpus.context(rows)
    model = tagging.train(around, buckets=1 << 10, rounds=20)
    model.write().save(str(tmp_path / "model"))
    held = PipelineModel.load(str(tmp_path / "model"))
    asked = [(1, 0, 0, "jumped", None), (1, 1, 0, "Madrid", []), (1, 2, 0, "Madrid", ["V"]), (1, 3, 0, "Madrid", ["Z", "V"]), (1, 4, 0, "x", ["Z"])]
    frame = corpus.context(spark.createDataFrame(asked, "doc_id long, sid long, tid int, form string, candidates array<string>"))
    found = [r.tag for r in tagging.tagged(frame, held).orderBy("sid").collect()]
    assert found == ["V", "N", "V", "V", "Z"]


def test_participles_are_marked_once(spark):
    rows = [("dus", "Afpmsrn", "dus", None), ("dus", "Vmp", "duce", None), ("dusă", "Afpfsrn", "dus", " x "), ("duși", "Afpmprn", "dus", "ParticipleLemma:y"), ("bun", "Afpmsrn", "bun", None), ("da", "Qz", None, None)]
    held = spark.createDataFrame(rows, "word string, msd string, lemma string, extra string")
    assert {r.word: r.extra for r in lexicon.participles(held).where("msd <> 'Vmp'").collect()} == {"dus": "ParticipleLemma:duce", "dusă": "x|ParticipleLemma:duce", "duși": "ParticipleLemma:y", "bun": None, "da": None}
    again = {(r.word, r.msd, r.lemma) for r in lexicon.participles(held, retag=True).collect()}
    assert again == {("dus", "Vmp--sm", "duce"), ("dus", "Vmp", "duce"), ("dusă", "Vmp--sf----r", "duce"), ("duși", "Vmp--pm", "duce"), ("bun", "Afpmsrn", "bun"), ("da", "Qz", None)}


def test_rules_against_brute_force(spark):
    """Random sentences; places inside, before and after the conditions; patterns of attributes see what is left."""
    rng = random.Random(5)
    made = [[(rng.choice("ab"), True, [(m, "x") for m in rng.sample(["N", "V", "A"], rng.randint(1, 3))]) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    checks = {"a": lambda t: t[0] == "a", "first_n": lambda t: t[1][0] == "N", "some_v": lambda t: "V" in t[1]}
    codes = {"a": "<+WORD=a>", "first_n": "<+msd0=N>", "some_v": "<+/msd[0-9]+/=V>"}
    for names, at, keep in [(("a", "some_v"), 1, False), (("first_n",), 1, True), (("some_v", "a"), -1, True), (("a",), 0, False), (("first_n", "some_v"), 3, False)]:
        want = []
        for tokens in made:
            left = [(w, [m for m, _ in c]) for w, _, c in tokens]
            for i in range(len(left)):
                if i + len(names) <= len(left) and 0 <= i + at < len(left) and all(checks[n](left[i + k]) for k, n in enumerate(names)):
                    kept = [m for m in left[i + at][1] if (m in "NA") == keep]
                    if kept:
                        left[i + at] = (left[i + at][0], kept)
            want.append(left)
        rule = tagging.Rule(tuple(codes[n] for n in names), at, "N|A", keep)
        got = {r.sid: [(t.form, [c.msd for c in t.candidates]) for t in r.tokens] for r in tagging.ruled(spark.createDataFrame(list(enumerate(made)), TOKENS), [rule]).collect()}
        assert [got[i] for i in range(len(made))] == want, (names, at)
