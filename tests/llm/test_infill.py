"""Fill-in-middle against lists of units, and back again."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def check(spark, docs):
    found = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in found.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r[:-1] for r in got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert sorted(r[-1] for r in got) == sorted(t or "" for _, t in rows)
    return got


def test_odd_rows(spark, odd_docs):
    check(spark, odd_docs)


def test_delimiters_marks_and_broken_marks(spark):
    alphabet = ["\x01", "\x02", "1", "2", "a", "bc", "<", "P", "S", ">", "<P", "M>", "é", "😀", "\n", "\r\n", "\\", "$0", " "]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 30)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate(("<P>", "x<S>y", "\x01", "\x02", "\x01\x02" * 50, "<", "<S", "M>", "\x01" + "1", "ab\x02cd"))]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_long_text_and_thousands_of_copies(spark):
    rows = [(1, "word, " * 400_000), (2, "x" * 3_000_000)] + [(3, "one two three")] * 5000
    found = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {(r["doc_id"], r["n"], r["back"]) for r in found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).select("doc_id", "n", F.sha2("back", 256).alias("back")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == {(1, 1_200_000, sha(rows[0][1])), (2, 1, sha(rows[1][1])), (3, 5, sha("one two three"))}
    assert found.count() == 5002


def test_empty_table_and_seeds(spark, no_docs):
    assert infill.fill_in_middle(no_docs).collect() == []
    docs = spark.createDataFrame([(i, "some words to be cut at two places") for i in range(50)], "doc_id long, text string")
    assert infill.fill_in_middle(docs, seed=7).collect() != infill.fill_in_middle(docs).collect()
    assert {r["form"] for r in infill.fill_in_middle(docs, plain_from=0).collect()} == {"plain"}
    assert {r["form"] for r in infill.fill_in_middle(docs, plain_from=100, spm_below=100).collect()} == {"spm"}


def test_plan_has_no_python_and_no_shuffle(spark, odd_docs):
    plan = infill.fill_in_middle(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize("column", ["doc_id", "text"])
def test_null_columns(spark, column):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumn(column, F.lit(None).cast("long" if column == "doc_id" else "string"))
    check(spark, docs)
