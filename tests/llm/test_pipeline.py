from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from corpusloom.llm import jaccard, lines, mixing, quality
from tests_llm_helpers import jaccard_brute, packing_check


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, step in pipeline.STAGES:
        docs = pipeline.stage(step(spark, docs, sf))
        out.append(docs)
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.select(pipeline.COLUMNS).collect()]


def test_columns(stages, spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(set(s.columns) == set(names) for s in stages[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]


def test_each_stage_works_on_what_is_left(stages, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = [tuple(r[c] for c in pipeline.COLUMNS) for r in docs.collect() if model.score(quality.indicators(r["text"])) >= 0.3]
    assert Counter(rows_of(stages[0])) == Counter(good)
    cut = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(stages[0]).collect()}
    assert {r[0]: r[1] for r in rows_of(stages[1])} == cut and len(rows_of(stages[1])) == len(good)
    kept = {r[0] for r in rows_of(stages[2])}
    want = jaccard_brute([(r[0], r[1]) for r in rows_of(stages[1])])
    assert kept == {int(d) for d, n, c in want if d == c or n == 0}
    copies = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(stages[2]).collect()}
    assert Counter(r[0] for r in rows_of(stages[3])) == Counter({d: n for d, n in copies.items() if n})
    texts = defaultdict(list)
    for r in rows_of(stages[3]):
        texts[r[0]].append(r[1])
    packing_check(stages[4].collect(), texts)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert Counter(rows) == Counter(stages[-1].select("doc_id", "piece", "length", "ids_crc32").collect())


def test_odd_rows(spark, odd_docs, no_docs, sf_dir, tmp_path):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for k, (_, step) in enumerate(pipeline.STAGES):
            docs = pipeline.stage(step(spark, docs, str(tmp_path)))
            assert k == 4 or docs.columns == pipeline.COLUMNS
    assert docs.count() == 0


def test_repeated_rows_are_mixed_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 6 + [(2, "d", "t"), (None, "e f", None)], "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in mixing.mixed_rows(docs).collect())
    want = Counter()
    for r in mixing.systematic_mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter({k: v for k, v in want.items() if v}) == sum((Counter({i: n}) for (i, _, _), n in got.items()), Counter())
    assert jaccard.keep_one(docs).count() == 3
