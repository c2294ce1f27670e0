import duckdb
import pytest

from corpusloom.llm import lines
from corpusloom.llm.queries import op6_lines, oracle_sql


def cut(spark, texts, **args):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in lines.drop_recurring_lines(docs, **args).collect()}


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({oracle_sql()['op6_lines']})").fetchall())
    rows = op6_lines(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == want and any(r["n_dropped"] for r in rows)


def test_fields_with_and_without_digits(spark):
    names = ["Ana", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"]
    texts = [f"{n} wrote {n}isms of {n}land\nPosted on 2024-01-{i:02d} at {i}:30 by {n} in news\n\nmore of {n}" for i, n in enumerate(names)]
    got = cut(spark, texts, min_docs=5)
    assert got[0]["text"] == texts[0] and got[0]["ln_dropped"] == 0
    for i in range(1, 8):
        assert got[i]["ln_dropped"] == 1 and got[i]["ln_lines"] == 4
        assert got[i]["text"] == f"{names[i]} wrote {names[i]}isms of {names[i]}land\n\nmore of {names[i]}"


def test_chance_neighbours_in_a_leaf_stay(spark):
    texts = [f"one two three a{c * 3} b{c * 4} d{c * 5} e{c * 2} f{c}" for c in "abcdefgh"]
    assert all(r["ln_dropped"] == 0 for r in cut(spark, texts, min_docs=5).values())


def test_below_the_number_of_documents_all_stays(spark):
    assert all(r["ln_dropped"] == 0 for r in cut(spark, ["same line here"] * 4, min_docs=5).values())
    assert sum(r["ln_dropped"] for r in cut(spark, ["same line here\nsame line here"] * 5, min_docs=5).values()) == 8


@pytest.mark.parametrize("rows", [400, 10_000])
def test_a_field_stays_one_at_any_number_of_rows(spark, rows):
    names = [a + b for a in "ABCDEFGHIJKLMNOPQRST" for b in "aeiouylmnr"]
    pairs = [(names[i % 200], names[(i // 200 * 7 + i) % 200]) for i in range(rows)]
    got = cut(spark, [f"Read more posts by {a} in {b.lower()}ton\nThanks for the {a}" for a, b in pairs])
    assert got[0]["ln_dropped"] == 0 and all(not r["text"].startswith("Read") for i, r in got.items() if i)


def test_equal_lines_with_digits_recur(spark):
    lines = ["Copyright 2021", "Page 3 of 10", "Posted 2024-01-02 12:30", "Tel: 030 123456"]
    got = cut(spark, ["\n".join([*lines, f"{i} {i * 7} {i * 3}"]) for i in range(10)])
    assert got[0]["ln_dropped"] == 0
    assert all(got[i]["ln_dropped"] == 4 and got[i]["text"] == f"{i} {i * 7} {i * 3}" for i in range(1, 10))
    assert all(r["ln_dropped"] == 0 for r in cut(spark, ["\n".join(lines)] * 9).values())


@pytest.mark.parametrize("min_docs", [1, 2])
def test_odd_rows(odd_docs, no_docs, min_docs):
    got = lines.drop_recurring_lines(odd_docs, min_docs=min_docs)
    assert got.columns == odd_docs.columns + ["ln_lines", "ln_dropped"]
    rows = got.collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["text"] is None and by[3]["ln_lines"] == 0 and by[4]["text"] == "" and by[4]["ln_lines"] == 0
    assert by[5]["text"] == " \t\n " and by[5]["ln_lines"] == 2 and by[7]["ln_dropped"] == 0
    assert by[1]["ln_dropped"] == 0 and by[2]["ln_dropped"] == (1 if min_docs <= 2 else 0)
    assert lines.drop_recurring_lines(no_docs).count() == 0
