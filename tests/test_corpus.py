import random
import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, lexicon, render, spans
from corpusloom.plans.registry import QUERIES
from corpusloom.sources import readers
from corpusloom.streaming import live
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = entry.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.select(columns).collect())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "sid", "start", "len"]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


SPAN = "doc_id long, sid long, span_id long, name string, start int, end int"


def test_crossing_nested_and_disjoint_spans(spark):
    rows = [(1, 0, 1, "A", 1, 5), (1, 0, 2, "A", 3, 8), (1, 1, 1, "A", 1, 5), (1, 1, 2, "A", 2, 4), (1, 2, 1, "A", 1, 2), (1, 2, 2, "A", 3, 4)]
    s = frame(spark, rows, SPAN)
    assert [tuple(r) for r in spans.crossing(s).collect()] == [(1, 0, 1, 2)]
    assert sorted((r.sid, r.span_id) for r in spans.nestable(s).collect()) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r.sid, r.span_id): r.level for r in spans.levels(s).collect()}[(1, 1)] == 1
    assert spans.mean_lengths(s).first().mean_length == pytest.approx((5 + 6 + 5 + 3 + 2 + 2) / 6)


def test_differences(spark):
    a, b = frame(spark, [(1, 0, 1, "A", 0, 2)], SPAN), frame(spark, [(1, 0, 1, "A", 1, 3)], SPAN)
    assert sorted(r.kind for r in spans.differences(a, b).collect()) == ["false", "missed"]
    assert spans.intersecting(a, b).count() == 1


XML = """<Document><S id="s0"><W LEMMA="a" MSD="Nc" x:RefId="t0">Ana</W><NP k="v"><W LEMMA="b">are</W><HEAD><W>mere</W></HEAD></NP></S>
<S><W x:RefId="t1">x</W><W x:RefId="t2">y</W></S><x:SpanAnnotation x:Name="X" x:StartTokenRefId="t1" x:EndTokenRefId="t2" f="1"/></Document>""".replace(
    "<Document>", '<Document xmlns:x="urn:x">'
)


def test_xml_corpus_and_back(spark):
    found = readers.xml_corpus(frame(spark, [(7, XML), (8, None)], "doc_id long, text string"))
    assert [tuple(r) for r in found["sentences"].orderBy("sid").select("doc_id", "sid", "first_tok", "n_tok").collect()] == [(7, 0, 0, 3), (7, 1, 3, 2)]
    tokens = [tuple(r) for r in found["tokens"].orderBy("sid", "tid").select("sid", "tid", "form", "lemma", "postag").collect()]
    assert tokens == [(0, 0, "Ana", "a", "Nc"), (0, 1, "are", "b", None), (0, 2, "mere", None, None), (1, 0, "x", None, None), (1, 1, "y", None, None)]
    held = [tuple(r) for r in found["spans"].orderBy("span_id").select("sid", "name", "start", "end", "prefer_inline").collect()]
    assert held == [(0, "NP", 1, 2, True), (0, "HEAD", 2, 2, True), (1, "X", 0, 1, False)]
    xml = {r.sid: r.xml for r in render.corpus_xml(found["tokens"], found["spans"]).collect()}
    assert xml[0] == '<S><W LEMMA="a" MSD="Nc">Ana</W><NP k="v"><W LEMMA="b">are</W><HEAD><W>mere</W></HEAD></NP></S>'
    assert xml[1] == '<S><X f="1"><W>x</W><W>y</W></X></S>'
    assert {r.name for r in corpus.attribute_names(found["tokens"]).collect()} == {"LEMMA", "MSD"}


def test_inferred_roles(spark):
    rows = [({"lemma": f"l{i}", "pos": f"p{i % 400}", "rel": f"r{i % 45}", "at": str(i % 12), "id": str(i)},) for i in range(900)]
    assert tuple(readers.inferred_roles(frame(spark, rows, "features map<string,string>")).first()) == (None, "lemma", "pos", "rel", "at")


def test_conll(spark):
    text = "# c\n1\tAna\tana\tN\t_\t_\t2\tnsubj\t_\t_\n2-3\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tare\tavea\tV\t_\t_\t0\troot\t_\t_\n\n1\tMere\tmăr\tN\t_\t_\t0\troot\t_\t_\n"
    rows = readers.conll(frame(spark, [(1, text)], "doc_id long, text string")).orderBy("sid", "tid").collect()
    assert [(r.sid, r.tid, r.form, r.lemma, r.xpostag, r.deprel) for r in rows] == [(0, 0, "Ana", "ana", None, "nsubj"), (0, 1, "are", "avea", None, "root"), (1, 0, "Mere", "măr", None, "root")]


def test_dictionary_round_trip_and_lookup(spark):
    text = "casă\tNcfsrn_casă\tVm_căsi_x\ncasa\tNcfsry_casă\nre-zis\tVm_zice\n###LexemPriorityTable\ncasă\t40\ncăsi\t2\n"
    found = readers.dictionary(frame(spark, [(1, text)], "doc_id long, text string"))
    assert sorted(r.value for r in render.dictionary_lines(found["entries"]).collect()) == sorted(text.split("\n")[:3])
    assert {tuple(r) for r in found["frequency"].collect()} == {("casă", 40), ("căsi", 2)}
    held = lexicon.with_stripped(found["entries"])
    tokens = frame(spark, [(1, "Casă"), (2, "casa"), (3, "ca-să"), (4, "zzz")], "i int, form string")
    never = {r.i: r.entries for r in lexicon.looked_up(tokens, lexicon.policy(held)).collect()}
    assert [e.msd for e in never[1]] == ["Ncfsrn", "Vm"] and [e.msd for e in never[2]] == ["Ncfsry"] and len(never[3]) == 2 and never[4] is None
    both = {r.i: r.entries for r in lexicon.looked_up(tokens, lexicon.policy(held, "both")).collect()}
    assert len(both[2]) == 3
    best = lexicon.most_frequent_lemma(found["entries"].select("word", "lemma"), found["frequency"], ["word"])
    assert {tuple(r) for r in best.collect()} == {("casă", "casă"), ("casa", "casă"), ("re-zis", "zice")}


def test_lists_and_tagged_lines(spark):
    lines = frame(spark, [("Ncm # noun",), ("# only",), ("﻿Vm",), ("Ncm",)], "value string")
    tags = readers.manual_tagset(lines)
    assert {r.msd for r in tags.collect()} == {"Ncm", "Vm"}
    assert [r.msd for r in readers.matching_tags(tags, frame(spark, [("N.*",)], "pattern string")).collect()] == ["Ncm"]
    rows = readers.tagged_lines(frame(spark, [(0, "un_om_Nc vine_Vm")], "line long, value string")).orderBy("tid").collect()
    assert [(r.form, r.tag) for r in rows] == [("un_om", "Nc"), ("vine", "Vm")]
    entry = readers.entry_lines(frame(spark, [("#x\t",), ("om\tLEMMA=om\tMSD=Nc\tq",)], "value string")).first()
    assert tuple(entry) == ("om", "Nc", "om", "q")


def test_best_tags_and_scores(spark):
    best = lexicon.best_tags(frame(spark, [("Ncfsrny",), ("Vmx",)], "msd string"), frame(spark, [("Ncfsrn",), ("Ncmsrn",), ("Vm",)], "msd string"))
    assert {tuple(r) for r in best.collect()} == {("Ncfsrny", "Ncfsrn"), ("Vmx", "Vm")}


def test_accuracy(spark):
    rows = frame(spark, [("Nc", "Nc", 1), ("Npx", "Npy", 0), ("Nc", "Vm", 0), ("Nc", "Vm", 2)], "gold string, found string, n_entries int")
    r = evaluation.accuracy(rows).first()
    assert (r.total, r.unambiguous, r.guesses, r.correct, r.correct_guesses, r.percent, r.percent_guesses) == (4, 1, 2, 2, 1, 50.0, 50.0)


@pytest.mark.parametrize(("word", "canonical", "stripped"), [("Câine", "cîine", "Caine"), ("ŞI", "și", "SI"), ("a–b c", "a-b~c", "a–b c"), ("Éva", "eva", "Eva")])
def test_words(spark, word, canonical, stripped):
    w = frame(spark, [(word,)], "w string").select(T.canonical_word(F.col("w")).alias("c"), T.stripped_diacritics(F.col("w")).alias("s"), T.shape(F.col("w")).alias("h")).first()
    assert (w.c, w.s) == (canonical, stripped) and w.h.has_cap == any(c.isupper() for c in word)


def test_carried_values(spark):
    rows = frame(spark, [(1, 1, None), (1, 2, "a"), (1, 3, None), (2, 1, None)], "doc_id long, i int, v string")
    got = {(r.doc_id, r.i): r.c for r in rows.withColumn("c", corpus.carried(rows, F.col("v"), ("doc_id",), "i")).collect()}
    assert got == {(1, 1): None, (1, 2): "a", (1, 3): "a", (2, 1): None}


def test_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = live.stream_sentences(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet"))
    run = stream.writeStream.format("memory").queryName("live_sentences").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("live_sentences").count() == corpus.sentences_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()


@pytest.mark.parametrize(("tag", "other", "score"), [
    ("Ncfsrn", "Ncfsrn", 4 * 111_111), ("Nc-s", "Ncfs", 4 * 110_100 + 1000), ("Nc", "Ncr", 4 * 110_000 + 2 * 1000), ("Afp", "Ncp", 1000), ("Afp", "Ap", 410_000),
    ("Mmfs", "Ncfs", 4 * 111_100), ("Crs", "Cr", 4 * 110_000), ("Pp3fsd", "Pp3fso", 4 * 111_111),
])
def test_tag_scores(spark, tag, other, score):
    assert frame(spark, [(tag, other)], "a string, b string").select(T.tag_score(F.col("a"), F.col("b")).alias("s")).first().s == score


def test_corrected_tags(spark):
    lex = frame(spark, [("casă", "Ncfsrn"), ("casă", "Vmip3s"), ("merge", "Vmip3s")], "word_key string, msd string")
    tags = frame(spark, [("Ncfsrn",), ("Ncmsrn",), ("Sp",), ("M",)], "msd string")
    rows = frame(spark, [("casă", "ncfsrn"), ("casa", "Vm"), ("casă", "Vm"), ("12", "Mc"), ("nou", "Ncm"), ("nou", "Xx")], "word string, msd string")
    got = {(r.word, r.msd): r.corrected for r in lexicon.corrected_tags(rows, lex, tags).collect()}
    assert got == {("casă", "ncfsrn"): "Ncfsrn", ("casa", "Vm"): "M", ("casă", "Vm"): "Vmip3s", ("12", "Mc"): "M", ("nou", "Ncm"): "Ncmsrn", ("nou", "Xx"): "M"}


def test_spelling_and_extras(spark):
    rows = frame(spark, [("reîntorcînd", "reîntoarce", None), ("cîine", None, ""), ("mîna", "mână", "x"), ("é", "e", "StrippedDiacritics(é)")], "w string, l string, e string")
    got = rows.select(T.restored_spelling(F.col("w"), F.col("l")).alias("r"), T.stripped_extra(F.col("w"), F.col("e")).alias("x"), T.unit_parts(F.lit("a~b-c.")).alias("u")).collect()
    assert [g.r for g in got] == ["reîntorcând", "câine", "mâna", "é"]
    assert [g.x for g in got] == [None, "StrippedDiacritics(cîine)", "x|StrippedDiacritics(mîna)", "StrippedDiacritics(é)"]
    assert got[0].u == ["a", "~", "b", "-", "c", "."]


def test_units_are_taken_from_the_left(spark):
    rows = frame(spark, [(1, 0, ["in", "the", "of", "the", "And", "x", "of", "the"])], "doc_id long, sid long, forms array<string>")
    got = [(r.tid, r.unit, r.n) for r in lexicon.longest_units(rows, ("of the", "of the and", "the of", "the and")).orderBy("tid").collect()]
    assert got == [(1, "the of", 2), (3, "the and", 2), (6, "of the", 2)]


SPANS = "doc_id long, sid long, span_id long, name string, start int, end int, features map<string,string>, prefer_inline boolean"


@pytest.mark.parametrize(("mode", "nested", "error"), [("inline", None, True), ("standoff", [], False), ("preserve", ["B", "C"], False), ("optimal", ["A", "C"], False), ("auto", ["B", "C"], False)])
def test_layout_modes(spark, mode, nested, error):
    tokens = frame(spark, [(1, 0, k, w, None) for k, w in enumerate("abcd")], "doc_id long, sid long, tid int, form string, features map<string,string>")
    rows = [(1, 0, 0, "A", 0, 2, None, False), (1, 0, 1, "B", 1, 3, {"k": "v"}, True), (1, 0, 2, "C", 2, 2, None, True)]
    written = render.corpus_xml(tokens, spark.createDataFrame(rows, SPANS), mode)
    got = written.first()
    assert (got.error is not None) == error and (got.xml is None) == error
    if not error:
        back = readers.xml_corpus(render.document_xml(written).withColumnRenamed("xml", "text"))
        held = {(r.name, r.start, r.end): (r.prefer_inline, r.features) for r in back["spans"].collect()}
        assert set(held) == {("A", 0, 2), ("B", 1, 3), ("C", 2, 2)} and held["B", 1, 3][1] == {"k": "v"}
        assert sorted(k[0] for k, v in held.items() if v[0]) == nested
        assert back["errors"].count() == 0


def test_index_of_mixed_files(spark, tmp_path):
    one = "<x><sent><w form='Ana' lemma='ana' pos='N'/><w form='are' lemma='avea' pos='V'/></sent></x>"
    two = "1\tMere\tmăr\tN\tNc\t_\t0\troot\t_\t_\n\n1\tda\tda\tI\t_\t_\t0\troot\t_\t_\n"
    bad, empty = "<x><s><w>a</w></s><sentence><w>b</w></sentence></x>", "<x><p>none</p></x>"
    held = readers.index_files(frame(spark, [(1, one), (2, two), (3, bad), (4, empty), (5, None)], "doc_id long, text string"), f"{tmp_path}/c")
    assert [(r.doc_id, r.sid, r.tid, r.form, r.lemma) for r in held["tokens"].orderBy("doc_id", "sid", "tid").collect()] == [
        (1, 0, 0, "Ana", "ana"), (1, 0, 1, "are", "avea"), (2, 0, 0, "Mere", "măr"), (2, 1, 0, "da", "da")]
    assert {r.doc_id: r.kind for r in held["errors"].collect()} == {3: "format", 4: "format"}
    assert [(r.doc_id, r.first_tok, r.n_tok) for r in readers.open_corpus(spark, f"{tmp_path}/c")["sentences"].orderBy("doc_id", "sid").collect()] == [(1, 0, 2), (2, 0, 1), (2, 1, 1)]


def test_frequency_and_word_lines(spark):
    got = readers.lemma_frequencies(frame(spark, [("\ufeffa~b 12",), ("",), ("c 3",)], "value string")).collect()
    assert [tuple(r) for r in got] == [("a b", 12), ("c", 3)]
    assert [r.form for r in readers.word_lines(frame(spark, [(0, " un  om ")], "line long, value string")).collect()] == ["un", "om"]


def test_tagged_outputs(spark):
    tokens = frame(spark, [(1, 0, 1, "x", "x", "N", None), (1, 0, 0, "de la", "de", "S", "e")], "doc_id long, sid long, tid int, form string, lemma string, postag string, extra string")
    assert render.tagged_text(tokens).first().value == "de~la_de_S_e x_x_N"
    assert render.tagged_json(tokens).first().value == '[{"WORD":"de la","Lemma":"de","MSD":"S"},{"WORD":"x","Lemma":"x","MSD":"N"}]'


@pytest.mark.parametrize("by", [-2, -1, 0, 1, 2, 9, -9])
def test_shifts_in_rows_equal_shifts_over_rows(spark, by):
    nested = frame(spark, [(1, 0, [True, False, True, True]), (1, 1, [False]), (1, 2, [])], "doc_id long, sid long, f array<boolean>")
    flat = nested.select("doc_id", "sid", F.posexplode("f").alias("tid", "x"))
    want = sorted((r.sid, r.tid, r.s) for r in flat.withColumn("s", corpus.shifted(flat, "x", by)).collect())
    got = sorted((r.sid, r.tid, r.s) for r in nested.select("sid", F.posexplode(corpus.shifted_in(F.col("f"), by)).alias("tid", "s")).collect())
    assert got == want


def test_broken_xml_stays_an_error_row(spark, tmp_path):
    line = "1\tOm\tom\tN\tNc\t_\t0\troot\t_\t_"
    files = frame(spark, [(1, "<D><S><W>a</W></S></D>"), (2, "<D>\n<S><W>a</W>\n</S>\n<D>"), (3, f"# c\n{line}\n\n{line}\n{line}\n"), (4, f"{line}\nno columns"), (5, None), (6, "")], "doc_id long, text string")
    held = readers.index_files(files, f"file://{tmp_path}/corpus")
    assert {r.doc_id for r in held["errors"].collect()} >= {2, 4}
    assert {(r.doc_id, r.sid, r.tid) for r in held["tokens"].where("doc_id = 3").collect()} == {(3, 0, 0), (3, 1, 0), (3, 1, 1)}
    assert held["tokens"].where("doc_id IN (2, 4)").count() == 0
    assert [r.c for r in files.select(readers.is_conll(F.col("text")).alias("c")).collect()] == [False, False, True, False, None, False]


def test_runs_and_failures_of_nested_sentences_equal_those_of_tokens(spark):
    rng = random.Random(4)
    rows = [(1, k, [rng.choice(["a", "b", None]) for _ in range(rng.randint(0, 8))]) for k in range(60)]
    nested = frame(spark, rows, "doc_id long, sid long, labels array<string>")
    flat = nested.select("doc_id", "sid", F.posexplode("labels").alias("tid", "label"))
    got = nested.select("sid", F.explode(corpus.runs(F.col("labels"))).alias("r")).select("sid", "r.*").collect()
    assert {tuple(r) for r in got} == {(r.sid, r.label, r.start, r.end) for r in corpus.islands(flat, "label").collect()} and len(got) > 50
    words = nested.select("doc_id", "sid", F.transform("labels", lambda x: F.struct(F.coalesce(x, F.lit("long word")).alias("form"), F.coalesce(x, F.lit("c")).alias("gold"), F.lit("a").alias("found"))).alias("words"))
    one_by_one = words.select("doc_id", "sid", F.posexplode("words").alias("tid", "w")).select("doc_id", "sid", "tid", "w.*")
    a, b = (sorted(map(str, f.select("sid", "tid", "form", "char_start").collect())) for f in (evaluation.failures_in(words), evaluation.failures(one_by_one)))
    assert a == b and a


def test_sums_before_each_place(spark):
    from corpusloom.functions.rows import let, sums_before

    rows = spark.createDataFrame([([3, 1, 4],), ([],), (None,), ([2, None, 5, 1],), ([7],)], "n array<int>").coalesce(1)
    assert [r[0] for r in rows.select(sums_before(F.col("n"))).collect()] == [[0, 3, 4], [], None, [0, 2, None, None], [0]]
    plan = rows.select(let(F.size("n"), lambda n: n + n).alias("x"))
    assert [r.x for r in plan.collect()] == [6, 0, None, 8, 2] and "element_at" in plan._jdf.queryExecution().optimizedPlan().toString()
    words = rows.select(F.lit(1).alias("doc_id"), F.lit(0).alias("sid"), F.transform("n", lambda n: F.struct(n.cast("string").alias("form"), F.lit("a").alias("gold"), F.lit("b").alias("found"))).alias("words"))
    assert "aggregate" not in evaluation.failures_in(words)._jdf.queryExecution().optimizedPlan().toString()
