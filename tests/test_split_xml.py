"""Large XML files split at their sentences, against one parse of the whole."""

import random

from corpusloom.sources import readers
from pyspark.sql import Window
from pyspark.sql import functions as F


def rows(frame):
    """Rows with sentences numbered densely in the order of their numbers."""
    by = Window.partitionBy("doc_id").orderBy("sid")
    dense = frame.withColumn("sid", F.when(F.col("sid").isNotNull(), F.dense_rank().over(by) - F.count_if(F.col("sid").isNull()).over(Window.partitionBy("doc_id")).cast("boolean").cast("int") - 1))
    return sorted(str((r.kind, r.sid, r.tid, r.start, r.end, r.name, r.form, r.ref, r.start_ref, r.end_ref, sorted(r.features.items()))) for r in dense.collect())


def test_splits_equal_the_whole(spark, tmp_path):
    rng, parts = random.Random(5), ["<?xml version='1.0'?>\n<D>\n<P id='1'>"]
    for k in range(1500):
        words = "".join(f'<W LEMMA="l{i}" RefId="{k}.{i}">{rng.choice(["é&amp;x", "word", "漢字"])}</W>' for i in range(rng.randint(0, 6)))
        parts.append(f'<S n="{k}"><NP type="x">{words}<W>z</W></NP></S>\n')
        if rng.random() < 0.1:
            parts.append(f'<SpanAnnotation Name="A{k}" StartTokenRefId="{k}.0" EndTokenRefId="{k}.0" kind="q"/>\n</P><P>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.xml").write_text("".join(parts) + "</P><SpanAnnotation Name='last' StartTokenRefId='0.0' EndTokenRefId='1.0'/></D>")
    whole = readers.parsed_xml(readers.whole_files(spark, f"file://{tmp_path}/in"), "S")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        split = readers.split_xml(spark, f"file://{tmp_path}/in", "S").cache()
        assert split.rdd.getNumPartitions() > 5
        assert rows(split) == rows(whole)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tables = readers.corpus_tables(split, readers.COMMON)
    assert tables["sentences"].count() == 1500 and tables["errors"].count() == 0
    assert [r.first_tok for r in tables["sentences"].orderBy("sid").limit(2).collect()][0] == 0


def test_a_broken_sentence_is_one_error(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<D><S><W>a</W></S><S><W>b<W></S><S><W>c</W></S><S2><W>no</W></S2></D>")
    (tmp_path / "b.xml").write_text("")
    (tmp_path / "c.xml").write_text("no xml at all")
    found = readers.split_xml(spark, f"file://{tmp_path}", "S").orderBy("sid").collect()
    assert [r.form for r in found if r.kind == "token"] == ["a", "c"] and [r.form for r in found if r.kind == "error"] == ["xml"]
