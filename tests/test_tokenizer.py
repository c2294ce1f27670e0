"""Sentences and tokens with their places, and tokens chosen by a dictionary."""

import itertools
import random

import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import tokenizer as K


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def sentences(spark, *texts, **lists):
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    return [[r.text for r in sorted(rows, key=lambda r: r.sid)] for _, rows in itertools.groupby(sorted(K.segmented(docs, **lists).collect(), key=lambda r: (r.doc_id, r.sid)), key=lambda r: r.doc_id)]


TEXT = " Ieri dr. Vlad Stan a dat 12,5 lei. Scrie J. Marin din S.R.L. Vest, e.g. aici. vezi ion.pop@posta.ro http://ex.ro/a?b=1\n\nAlt rând, fără punct\nși mai jos! Ultima (chiar) oară?"


def test_sentences_keep_abbreviations_and_addresses(spark):
    got = sentences(spark, TEXT, abbreviations=("dr", "etc.", "e.g."))
    assert got == [["Ieri dr. Vlad Stan a dat 12,5 lei.", "Scrie J. Marin din S.R.L. Vest, e.g. aici.", "vezi ion.pop@posta.ro http://ex.ro/a?b=1", "Alt rând, fără punct\nși mai jos!", "Ultima (chiar) oară?"]]
    assert sentences(spark, "Vine dr. Stan. Pleacă.") == [["Vine dr.", "Stan.", "Pleacă."]]


def test_abbreviations_that_are_words_too_and_before_one(spark):
    text = "Este un om. Vine luni nr. Acum pleacă. dr. Stan rămâne."
    assert sentences(spark, text, abbreviations=("nr", "om", "dr")) == [["Este un om. Vine luni nr. Acum pleacă. dr. Stan rămâne."]]
    assert sentences(spark, text, abbreviations=("nr", "om", "dr"), ambiguous=("om",)) == [["Este un om.", "Vine luni nr. Acum pleacă. dr. Stan rămâne."]]
    assert sentences(spark, "Așa ... Da... nu știu. Bine.") == [["Așa ... Da...", "nu știu.", "Bine."]]


def test_rows_without_sentences(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, " \n\t \n\n "), (4, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.sid, r.start, r.end, r.text) for r in K.segmented(docs).collect()] == [(4, 0, 0, 1, "x")]
    assert K.tokenized(K.segmented(docs)).count() == 1


def test_places_over_the_table(spark, sf_dir):
    """Every sentence and token stands where it says, tokens cover all that is no white space, and sentences all but what is between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = frame(spark, [(-1, TEXT), (-2, "😀 a.b c😀d! Éx (http://x.ro/é)."), (-3, "word " * 5000), (-4, ". " * 3000)], "doc_id long, text string")
    both = docs.unionByName(odd).cache()
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    rows = K.segmented(both).cache()
    at = {}
    for r in rows.collect():
        assert texts[r.doc_id][r.start : r.end] == r.text
        at.setdefault(r.doc_id, []).append((r.sid, r.start, r.end))
    for doc, text in texts.items():
        spans = sorted(at.get(doc, []))
        assert [s for s, _, _ in spans] == list(range(len(spans)))
        ends = [0, *(e for _, _, e in spans)]
        assert all(text[e:s].strip() == "" for e, s in zip(ends, [*(s for _, s, _ in spans), len(text)], strict=True))
    covered = {}
    for r in K.tokenized(rows).collect():
        assert texts[r.doc_id][r.start : r.end] == r.form
        covered.setdefault(r.doc_id, []).append((r.start, r.end))
    for doc, text in texts.items():
        spans = sorted(covered.get(doc, []))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert "".join(text[s:e] for s, e in spans) == regex.sub(r"[\s\p{Z}]", "", text)


@pytest.mark.parametrize(("text", "words"), [
    ("are 3,14 și 20.500 lei", ["are", "3,14", "și", "20.500", "lei"]), ("Maria-Ioana \t Ion-Vasile!", ["Maria-Ioana", "Ion-Vasile", "!"]),
    ("scrie la ion.p@posta.ro, vezi https://ex.ro.", ["scrie", "la", "ion.p@posta.ro", ",", "vezi", "https://ex.ro", "."]), ("Un'tare dom'le", ["Un'tare", "dom'le"]),
    ("60-7 -3", ["60", "-7", "-3"]), ("«da» ...", ["«", "da", "»", ".", ".", "."]), ("S.R.L. e bun.", ["S.R.L.", "e", "bun", "."]), ("a--b etc.Ana x.y", ["a--b", "etc", ".", "Ana", "x.y"]),
])
def test_words(spark, text, words):
    s = frame(spark, [(1, 0, 5, text)], "doc_id long, sid long, start int, text string")
    rows = K.tokenized(s).orderBy("tid").collect()
    assert [r.form for r in rows] == words == frame(spark, [(text,)], "t string").select(T.words(F.col("t")).alias("w")).first().w
    assert [text[r.start - 5 : r.end - 5] for r in rows] == words


def fold(spans):
    """Two lists walked with removal, as one would by hand."""
    spans, i = sorted(spans), 0
    while i < len(spans):
        for j in range(i + 1, len(spans)):
            (a, b), (c, d) = spans[i], spans[j]
            if c < b:
                if a == c or b == d:
                    spans[i] = (a, max(b, d))
                del spans[j]
                break
            if c > b:
                i += 1
                break
        else:
            i += 1
    return spans


def test_overlapping_candidates(spark):
    rng = random.Random(3)
    rows = [(k, [(s, s + rng.randint(1, 5)) for s in rng.choices(range(12), k=rng.randint(0, 9))]) for k in range(400)]
    got = frame(spark, rows, "k int, c array<struct<start:int,end:int>>").select("k", K.unified(F.col("c")).alias("u")).collect()
    assert {r.k: [tuple(x) for x in r.u] for r in got} == {k: fold(c) for k, c in rows}


def by_hand(word, freq):
    """All ways to give hyphens to their neighbours, one by one."""
    bare = word.rstrip("-")
    if "-" not in word[1:-1] or word in freq or "-" not in bare:
        return None
    parts = bare.split("-")
    for k in (4, 3, 2):
        groups = ["-".join(parts[i : i + k]) for i in range(len(parts) - k + 1)]
        hits = [i for i, g in enumerate(groups) if {g, "-" + g, g + "-"} & freq.keys()]
        if hits:
            parts[hits[0] : hits[0] + k] = ["-".join(parts[hits[0] : hits[0] + k])]
            break
    ways = []
    for code in range(2 ** (len(parts) - 1)):
        tokens, front = [], ""
        for i, p in enumerate(parts):
            left = i < len(parts) - 1 and not code >> i & 1
            tokens.append(front + p + ("-" if left else ""))
            front = "" if left else "-"
        score = sum((10 if t[0] == "-" or t[-1] == "-" else 1) for t in tokens if t in freq)
        ways.append((score, sum(freq.get(t, -100) for t in tokens), -code, tokens))
    best = max(ways)
    if best[1] <= 0 or len(best[3]) < 2:
        return None
    return [*best[3][:-1], best[3][-1] + word[len(bare) :]]


def test_hyphens_against_all_ways(spark):
    rng = random.Random(11)
    syllables = ["a", "le", "i", "mi", "s", "cha"]
    forms = {f"{'-' * rng.randint(0, 1)}{'-'.join(rng.choices(syllables, k=rng.choice([1, 1, 1, 2, 3])))}{'-' * rng.randint(0, 1)}": rng.randint(0, 300) for _ in range(60)}
    words = sorted({"-".join(rng.choices([*syllables, "zz"], k=rng.randint(1, 6))) + "-" * (rng.random() < 0.1) for _ in range(500)} | {"--", "a--i", "-a-i", "a-", "x-y"})
    freq = {}
    for f, n in forms.items():
        freq[f] = freq.get(f, 0) + n
    got = K.hyphen_parts(frame(spark, [(w,) for w in words], "word string"), frame(spark, list(freq.items()), "word_key string, freq long")).collect()
    assert {r.word: r.parts for r in got} == {w: p for w in words if "--" not in w.rstrip("-") and (p := by_hand(w, freq))} | {r.word: r.parts for r in got if "--" in r.word.rstrip("-")}
    assert len(got) > 100 and all("".join(r.parts) == r.word for r in got)


def test_tokens_by_a_dictionary(spark):
    dictionary = frame(spark, [("de~la", 50), ("de~la~sine", 5), ("și", 90), ("-au", 70), ("s-", 60), ("etc.", 3), ("într-", 40), ("-un", 40), ("un", 99), ("ex.ro", 1), ("au", 9), ("a~fi.", 2), ("a~fi", 2)], "word_key string, freq long")
    s = frame(spark, [(1, 0, 10, "Vine de la  sine, de la Cluj; s-au dus într-un loc etc. la http://s-au.ro/s-au și n-avea a fi.")], "doc_id long, sid long, start int, text string")
    rows = K.tokenized(s, dictionary).orderBy("tid").collect()
    assert [r.form for r in rows] == ["Vine", "de la  sine", ",", "de la", "Cluj", ";", "s-", "au", "dus", "într-", "un", "loc", "etc.", "la", "http://s-au.ro/s-au", "și", "n-avea", "a", "fi", "."]
    text = s.first().text
    assert all(text[r.start - 10 : r.end - 10] == r.form for r in rows)
    plain = K.tokenized(s).orderBy("tid").collect()
    assert "s-au" in [r.form for r in plain] and "de la" not in [r.form for r in plain]


def test_thousands_of_equal_sentences_and_an_empty_dictionary(spark):
    dictionary = frame(spark, [("de~la", 5)], "word_key string, freq long")
    s = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("sid"), F.lit(0).alias("start"), F.lit("vin de la de la").alias("text"))
    got = K.tokenized(s, dictionary).groupBy("form").count().collect()
    assert {(r["form"], r["count"]) for r in got} == {("vin", 3000), ("de la", 6000)}
    assert K.tokenized(s.limit(3), dictionary.limit(0)).count() == 15
    assert K.tokenized(s.limit(0), dictionary).count() == 0


ODD = ["a.b c@d.ee. Www.x.y/z?", "www.ab", "www. x", "A. B. c", "A.B. c", "x:y z", "ab.cde/f(g.h) i", " lead ing x\u000by", "-3 a-b 4,5", "x" * 19 + " " + "y" * 20, "", "  ", "...!?", "é😀.b 😀", "a .b"]


def test_texts_without_signs_are_not_searched_and_lose_nothing(spark):
    rows = spark.createDataFrame([(t,) for t in [*ODD, None]], "text string")
    got = rows.select(T.nonbreakable_spans(F.col("text")).alias("a"), T._found(F.col("text"), T.NONBREAKABLE).alias("b"), T._hidden(F.col("text")).alias("h"), "text").collect()
    assert all(r.a == r.b for r in got) and sum(bool(r.a) for r in got) >= 4
    plain = rows.select(T.nonbreakable_spans(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plain.index("RLIKE") < plain.index("regexp_replace")


def test_words_that_overlap_nothing_are_placed_a_batch_at_once(spark):
    rows = spark.createDataFrame([(1, k, 10, t) for k, t in enumerate([*ODD, None])], "doc_id long, sid long, start int, text string").coalesce(1)
    found = K.tokenized(rows)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    text = F.col("text")
    one = F.explode(K.unified(F.concat(T.word_spans(text), T._found(text, T.NONBREAKABLE)))).alias("s")
    want = rows.select("sid", "text", one).select("sid", F.expr("substr(text, s.start + 1, s.end - s.start)").alias("form"), F.expr("s.start + 10"), F.expr("s.end + 10")).collect()
    assert sorted((r.sid, r.form, r.start, r.end) for r in found.collect()) == sorted(map(tuple, want))
    assert [r.tid for r in found.where("sid = 3").orderBy("tid").collect()] == list(range(found.where("sid = 3").count()))


def test_places_ask_for_units_without_a_fold(spark):
    s = spark.createDataFrame([(1, 0, "the big city is big ~ city"), (1, 1, "big"), (1, 2, "big city")], "doc_id long, sid long, text string")
    found = K.unit_spans(s, spark.createDataFrame([("big~city",), ("is~big",), ("a.",)], "word_key string"))
    assert sorted((r.sid, [(u.start, u.end) for u in r.units]) for r in found.collect()) == [(0, [(4, 12), (13, 19)]), (2, [(0, 8)])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "flatten" not in plan


def test_units_of_few_keys_move_no_sentence(spark, monkeypatch):
    rng = random.Random(5)
    words = ["de", "la", "sine", "a", "fi.", "și", "nu.", "Ce", "-", "1"]
    s = frame(spark, [(d, k, 0, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for d in range(20) for k in range(10)] + [(99, 0, 0, None)], "doc_id long, sid long, start int, text string")
    dictionary = frame(spark, [(w, 9) for w in ("de~la", "de~la~sine", "a~fi.", "a~fi", "la~sine~a", "nu.", "și~nu.", "ce~-", "-~1", "de", "la", None)], "word_key string, freq long")
    got = K.units_in(s, dictionary)
    by_joins = {(r.doc_id, r.sid): sorted(map(tuple, r.units)) for r in K.unit_spans(s, dictionary).collect() if r.units}
    assert {(r.doc_id, r.sid): sorted(map(tuple, r.units)) for r in got.collect() if r.units} == by_joins and len(by_joins) > 50
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    tokens = K.tokenized(s, dictionary)
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("Union")[1]
    monkeypatch.setattr(K, "MOST_UNITS", 3)
    assert K.units_in(s, dictionary) is None
    assert sorted(map(tuple, K.tokenized(s, dictionary).collect())) == sorted(map(tuple, tokens.collect()))
