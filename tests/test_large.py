"""What must hold when tables grow: alike nodes, long sequences, keys that are mostly missing, matches that are mostly none."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpusloom.operators import lexicon, spans, tagging
from corpusloom.plans import grammar as G
from corpusloom.plans import inference as I
from corpusloom.plans import outputs, registry, rules


def frame(spark, texts):
    return spark.createDataFrame([(list(t),) for t in texts], "keys array<string>")


def test_many_alike_nodes_are_one_kind(spark, monkeypatch):
    monkeypatch.setattr(I, "MOST_PAIRS", 60)
    found = I.infer(frame(spark, ["c" + "l" * k + "s" for k in range(40)]), "k", similarity=0.0)
    assert len(found.graphs["Main"].nodes) == 5


def test_pairs_of_nodes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 4)
    rows = [(n, "k" + str(n % 2), side, x) for n in range(20) for side, x in (("before", "ab"[n % 3 == 0]), ("after", I.END if n % 5 == 0 else "xyz"[n % 3]))]
    got = {(r.a, r.b): r.similarity for r in I.similar_nodes(spark.createDataFrame(rows, "node long, key string, side string, neighbour string")).collect()}
    of = lambda n: {r[1:] for r in rows if r[0] == n}
    size = lambda n: sum(r[2] != I.END for r in of(n))
    want = {}
    for a, b in itertools.combinations(range(20), 2):
        if shared := of(a) & of(b):
            want[a, b] = 4 * len(shared) / (size(a) + size(b) + 2 * sum(r[2] == I.END for r in shared)) - 1
    assert got == want


def test_prefixes_are_counted_by_number(spark):
    rows = I._prefixes(I._spread(frame(spark, ["abc", "abd", "x"])), rests=True)
    assert not any(isinstance(f.dataType, ArrayType) for f in rows.schema)
    assert rows.count() == 10
    assert {("".join(r.prefix), r.alike) for r in I.states(frame(spark, ["ac", "bc"])).collect()} == {("", 1), ("a", 2), ("b", 2), ("ac", 2), ("bc", 2)}


def test_words_without_a_second_key_are_spread(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        words = spark.createDataFrame([(f"w{n}",) for n in range(2000)] + [("w1-w2",), (None,)], "form string")
        entries = spark.createDataFrame([("w1", "N", "w"), ("w1w2", "V", "v")], "word_key string, msd string, lemma string")
        found = lexicon.looked_up(words, entries)
        sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 1200
        assert {r.form for r in found.where("entries IS NOT NULL").collect()} == {"w1", "w1-w2"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


NODES = G.Grammar({"Main": G.Graph({0: G.Node("<E>", [1]), 1: G.Node("<+w=a>", [1, 2], output="<A>"), 2: G.Node("<+w=b>", [3], output='<B +k="v">'), 3: G.Node("<E>")}, 0, 3)})


def sentences(spark):
    held = [(0, list("aabab")), (1, list("xxxx")), (2, []), (3, list("xaab")), (4, list("aabaaab"))]
    rows = [(1, k, [{"w": w} for w in ws]) for k, ws in held]
    return spark.createDataFrame(rows, "doc_id long, sid long, features array<map<string,string>>").coalesce(1)


def test_visits_are_the_counts_of_visited_nodes(spark):
    traced = G.match(sentences(spark), NODES, traced=True)
    rows = outputs.visited(traced).groupBy("graph", "node").agg(F.count("*").alias("n"), F.countDistinct("sid", "match_start").alias("n_matches"))
    assert sorted(map(tuple, outputs.visits(traced).collect())) == sorted(map(tuple, rows.collect()))


def test_equal_matches_share_a_path_at_their_own_places(spark):
    found = [(r.sid, r.match_start, r.number, r.name, r.start, r.end) for r in outputs.spans_of(G.match(sentences(spark), NODES, traced=True)).collect()]
    starts = {(0, 0): 3, (0, 3): 2, (3, 1): 3, (4, 0): 3, (4, 3): 4}
    want = []
    for (sid, at), n in starts.items():
        want += [(sid, at, k, "A", at + k, at + k) for k in range(n - 1)] + [(sid, at, n - 1, "B", at + n - 1, at + n - 1)]
    assert sorted(found) == sorted(want)


def test_sentences_without_a_start_stay_out_of_python(spark):
    wanted = G.Grammar({"Main": G.sequence("=>:Two", "<+w=a>"), "Two": G.sequence("<+w=b>", "<+w=a>")})
    assert G.first_bits(wanted, "Main", G.clauses_of(wanted)) == ({G.clauses_of(wanted).index(G.parse_clauses("<+w=a>")[0])}, True)
    found = G.match(sentences(spark), wanted)
    assert sorted((r.sid, r.start) for r in found.collect()) == [(0, 0), (0, 1), (0, 3), (4, 0), (4, 1), (4, 3), (4, 4), (4, 5)]
    assert "RLIKE" in found._jdf.queryExecution().executedPlan().toString()


def test_rules_keep_nulls_and_other_fields(spark):
    kind = "array<struct<form:string,in_dict:boolean,candidates:array<struct<msd:string,lemma:string,freq:bigint>>>>"
    two = [("Nc", "n", 1), ("Vm", "v", 2)]
    held = [[("the", True, [("D", "the", 9)]), ("run", True, two), ("run", True, two)], None, [], [("the", False, None), ("run", False, None)], [("x", True, two), ("the", True, []), ("go", True, two)]]
    rows = spark.createDataFrame([(k, ts) for k, ts in enumerate(held)], f"doc_id long, tokens {kind}").coalesce(1)
    rule = G.Grammar({"Main": G.sequence(":R"), "R": G.sequence("<+WORD=the>", ("<+/msd[0-9]+/=Nc>", '<KEEP +regex="N.*">'))})
    got = {r.doc_id: r.tokens and [(t.form, t.candidates and [tuple(c) for c in t.candidates]) for t in r.tokens] for r in rules.ruled(rows, rule).collect()}
    noun = two[:1]
    assert got[0] == [("the", [("D", "the", 9)]), ("run", noun), ("run", two)]
    assert got[1] is None and got[2] == [] and got[3] == [("the", None), ("run", None)]
    assert got[4] == [("x", two), ("the", []), ("go", noun)]


def test_differences_compute_each_side_once(spark):
    kind = "doc_id long, sid long, start int, end int"
    found = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 2), (1, 0, 3, 4), (None, 0, 1, 1)], kind)
    gold = spark.createDataFrame([(1, 0, 3, 4), (1, 0, 5, 5), (None, 0, 1, 1)], kind)
    got = spans.differences(found, gold)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, 0, 1, 2, "false")] * 2 + [(None, 0, 1, 1, "false"), (1, 0, 5, 5, "missed"), (None, 0, 1, 1, "missed")], key=key)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nestable_spans_are_computed_once(spark):
    rows = spark.createDataFrame([(1, 0, 1, "X", 0, 3), (1, 0, 2, "X", 2, 5), (1, 0, 3, "X", 2, 3), (1, 1, 4, "X", 0, 1)], "doc_id long, sid long, span_id long, name string, start int, end int")
    found = spans.nestable(rows.withColumn("span_id", F.col("span_id") + F.length(F.lit("marker"))))
    assert "LocalRelation" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.span_id for r in found.collect()) in ([7, 9, 10], [8, 9, 10])


def test_rules_do_not_ask_for_types_at_each_step(spark):
    rows = spark.createDataFrame([(1, [("the", True, [("D", "x")]), ("run", True, [("Nc", "x"), ("Vm", "x")])])], "doc_id long, tokens array<struct<form:string,in_dict:boolean,candidates:array<struct<msd:string,lemma:string>>>>")
    found = tagging.ruled(rows, [tagging.Rule(("<+WORD=the>", "<+/msd[0-9]+/=Nc>"), 1, "N.*")])
    assert [[c.msd for c in t.candidates] for t in found.first().tokens] == [["D"], ["Nc"]]
    assert "element_at(CASE" in found._jdf.queryExecution().optimizedPlan().toString()


def test_intersecting_spans_do_not_meet_each_with_each(spark):
    kind = "doc_id long, sid long, span_id long, start int, end int"
    numbers = random.Random(1)
    some = lambda n: [(d, s, k, a := numbers.randint(-3, 40), a + numbers.randint(-1, 6)) for k in range(n) for d, s in ((1, 0), (1, 1), (2, 0))]
    found = [*some(25), (1, 0, 7, 5, 9), (1, 0, 7, 5, 9), (3, 0, 1, 0, 9), (None, 0, 1, 0, 9), (4, 0, 1, None, 5), (4, 0, 2, 50, None), (4, 0, 3, None, None)]
    gold = [*some(5), (None, 0, 1, 0, 9), (4, 0, 1, 5, 6), (4, 0, 2, None, 90), (4, 0, 3, 0, None), (5, 0, 1, 0, 9)]
    within = lambda x, g: None not in (x, g[3], g[4]) and g[3] <= x <= g[4]
    want = [f for f in found if f[0] is not None and any(f[:2] == g[:2] and (within(f[3], g) or within(f[4], g)) for g in gold)]
    got = spans.intersecting(spark.createDataFrame(found, kind), spark.createDataFrame(gold, kind))
    key = lambda r: tuple(map(str, r))
    assert 0 < len(want) < len(found) and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_are_the_matches_in_their_rows(spark):
    wanted = G.Grammar({"Main": G.sequence("<+w=a>", "<+w=b>")})
    rows = sentences(spark)
    cut = G.cuts(rows.withColumn("gold", F.expr("transform(array(1, 5), s -> named_struct('start', s, 'end', s + 1))")), wanted, keep=("gold",))
    held = {r.sid: r.cuts for r in cut.collect()}
    matches = {(k, sum(c[:i]), sum(c[: i + 1]) - 1) for k, c in held.items() for i in range(1, len(c), 2)}
    assert matches == {(r.sid, r.start, r.start + r.len - 1) for r in G.match(rows, wanted).collect()} == {(0, 1, 2), (0, 3, 4), (3, 2, 3), (4, 1, 2), (4, 5, 6)}
    assert sorted((r.sid, r.start, r.end) for r in spans.intersecting_cuts(cut, "cuts", "gold").collect()) == [(0, 1, 2), (3, 2, 3), (4, 1, 2), (4, 5, 6)]
    with pytest.raises(G.GrammarError):
        G.cuts(rows, G.Grammar({"Main": G.sequence("=>:Two", "<+w=a>"), "Two": G.sequence("<+w=b>")}))


def test_intersecting_spans_cut_each_text_once_and_move_nothing(spark, sf_dir):
    plan = registry.intersecting_spans(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_symbols_by_one_value_test_no_clause(spark):
    clauses = G.parse_clauses("<+k=a>|<+k=b -k=c>|<-k=a>|<+other=x>|<-other=x +k=b>|<>")
    rows = spark.createDataFrame([(["a", "b", "c", "zz", "", None],), ([],), (None,)], "ws array<string>").coalesce(1)
    maps = rows.withColumn("ms", F.transform("ws", lambda w: F.when(w.isNull(), F.create_map(F.lit("n"), F.lit("n"))).otherwise(F.create_map(F.lit("k"), w))))
    both = maps.select(G.symbols(clauses, "ws", lambda w: {"k": w, "unasked": F.length(w)}).alias("a"), G.symbols(clauses, "ms").alias("b"))
    assert all(r.a == r.b for r in both.collect())
    assert "substr" not in both.select("a")._jdf.queryExecution().optimizedPlan().toString()


def test_similar_nodes_tell_lower_case_words_by_their_letters(spark, tmp_path):
    """The rows of the SQL, whose examples are not reduced to four kinds."""
    texts = ["Ana are mere. Ana ala bere! Dan bea, 12 13 cai", "Ala are bere. Dan are. Ana, Ana are apa mica."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in registry.similar_nodes(spark, str(tmp_path)).collect())
    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((a, b, round(s, 9)) for a, b, s in held.execute(registry.oracle_sql()["similar_nodes"]).fetchall())
    assert got == want and any("low e low a" in r[0] for r in got)


def test_blocks_of_nodes_follow_their_names_and_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_CHARS", 300)
    rows = [("x" * 100 + str(n), "k", "before", "ab"[n % 3 == 0]) for n in range(20)]
    found = I.similar_nodes(spark.createDataFrame(rows, "node string, key string, side string, neighbour string"))
    assert found.count() == 13 * 12 // 2 + 7 * 6 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_bootstrap_computes_its_sentences_and_spans_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counting(rows, count):
        def run(batches):
            for b in batches:
                count.add(b.num_rows)
                yield b

        return rows.mapInArrow(run, rows.schema)

    texts = ["dnvdan", "vdaan", "dnv", "nvn", "daav"]
    rows = spark.createDataFrame([(1, i, [{"w": c, "v": "x"} for c in t]) for i, t in enumerate(texts)], "doc_id long, sid long, features array<map<string,string>>")
    gold = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 3, 5), (1, 1, 1, 4), (1, 2, 0, 1)], "doc_id long, sid long, start int, `end` int")
    _, found = I.bootstrap(counting(rows, seen[0]), counting(gold, seen[1]), "w")
    assert sorted(map(tuple, found.select("doc_id", "sid", "start", "end").collect())) == sorted(map(tuple, gold.collect()))
    assert [s.value for s in seen] == [5, 4]


def test_differing_tokens_against_sets(spark):
    numbers = random.Random(9)
    some = lambda n: [(numbers.choice([1, 2, None]), numbers.randint(0, 2), a := numbers.randint(0, 12), a + numbers.randint(0, 4)) for _ in range(n)]
    ddl, both = "doc_id long, sid long, start int, `end` int", some(10)
    found, gold = some(12) + both, some(12) + both
    tokens = lambda spans: {(d, s, t) for d, s, a, b in spans for t in range(a, b + 1)}
    less = lambda x, y: {t for t in tokens(x) if t[0] is None or t not in tokens(y)}
    extra, missed, _ = I.compared(spark.createDataFrame(found, ddl), spark.createDataFrame(gold, ddl))
    assert set(map(tuple, extra.collect())) == less(found, gold) and set(map(tuple, missed.collect())) == less(gold, found)
    assert extra.count() == len(less(found, gold))
