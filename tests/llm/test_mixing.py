import duckdb

from corpusloom.llm import mixing
from corpusloom.llm.queries import op3_mixing


def test_equals_sql(spark, sf_dir):
    sql = mixing.SYSTEMATIC_MIX_SQL.replace("{documents}", f"'{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(sql).fetchall())
    got = sorted(tuple(r) for r in op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_odd_rows(odd_docs):
    rows = mixing.systematic_mix(odd_docs).collect()
    assert len(rows) == 10
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert all(0 <= r["copies"] <= 2 for r in rows)
    by = {r["source"]: r for r in rows}
    assert by[None]["target"] == 0
    # b weighs 1 and has 20 words: it is capped at twice that, as is é; the rest goes to a.
    assert by["b"]["target"] == 40 and by["é"]["target"] == 2 * by["é"]["source_size"]
    total = sum(r["source_size"] for r in by.values())
    assert abs(sum(r["target"] for r in by.values()) - 1.5 * total) < 1e-6


def test_reruns_agree_and_empty(odd_docs, no_docs):
    a, b = (sorted(map(str, mixing.systematic_mix(odd_docs.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    assert mixing.systematic_mix(no_docs).count() == 0


def test_hot_source_comes_near_its_target(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 50)) AS text", "if(id % 3 < 2, 'hot', concat('s', id % 7)) AS source")
    for r in mixing.systematic_mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 50
