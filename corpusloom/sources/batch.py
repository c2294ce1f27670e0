"""A folder of XML files matched by a grammar: one output for each file, under its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render
from ..plans import outputs
from ..plans.grammar import Grammar, match
from . import readers
from .shared import written


def annotated_files(spark: SparkSession, path: str, grammar: Grammar, sentence: str | None = None, mode: str = "auto") -> DataFrame:
    """``name, xml, error``: each file under ``path`` with the spans that the grammar's outputs write, beside those it had.

    ``sentence`` names the sentence element (inferred without it). A file that cannot be parsed, or whose matches have a fault, has no xml and a reason in
    ``error``; the others go on. A file is one document, so one row holds it whole; files are spread over tasks.
    """
    files = readers.whole_files(spark, path).withColumn("name", F.regexp_extract("path", r"[^/]*\z", 0))
    # Files are parsed once, and matched once: both are read by several parts of the result.
    parsed = written(readers.parsed_xml(files.select("doc_id", "text"), sentence))
    layout = {"form": None, "lemma": None, "postag": None} | readers.inferred_roles(parsed.where("kind = 'token'")).first().asDict()
    tables = {k: written(v) if k in ("tokens", "spans") else v for k, v in readers.corpus_tables(parsed, layout).items()}
    # What a grammar sees of a token: its attributes, and its form as WORD.
    own = F.map_concat(F.coalesce("features", F.create_map().cast("map<string,string>")), F.map_filter(F.create_map(F.lit("WORD"), F.col("form")), lambda _, v: v.isNotNull()))
    seen = tables["tokens"].select("doc_id", "sid", "tid", F.map_from_entries(F.array_distinct(F.map_entries(own))).alias("seen"))
    sentences = seen.groupBy("doc_id", "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("tid", F.map_entries("seen").alias("seen")))), lambda t: F.map_from_entries(t["seen"])).alias("features"))
    found = written(outputs.spans_of(match(sentences, grammar, traced=True)))
    wanted = ["doc_id", "sid", "span_id", "name", "start", "end", "features", "prefer_inline"]
    held = outputs.annotations(found).withColumn("prefer_inline", F.lit(True))
    before = tables["spans"]
    before = before.select(*(c if c in before.columns else F.lit(False).alias(c) for c in wanted))
    spans = before.unionByName(held.select(*wanted).select(*(F.col(c).cast(before.schema[c].dataType).alias(c) for c in wanted)))
    rendered = written(render.corpus_xml(tables["tokens"], written(spans), mode))
    faults = found.where("fault IS NOT NULL").select("doc_id", F.col("fault").alias("reason"))
    failed = tables["errors"].select("doc_id", F.col("kind").alias("reason")).unionByName(faults).unionByName(rendered.where("error IS NOT NULL").select("doc_id", F.col("error").alias("reason")))
    reasons = failed.groupBy("doc_id").agg(F.min("reason").alias("error"))
    documents = render.document_xml(rendered.where("error IS NULL"))
    both = files.select("doc_id", "name").join(documents, "doc_id", "left").join(reasons, "doc_id", "left")
    return both.select("name", F.when(F.col("error").isNull(), F.col("xml")).alias("xml"), "error")


def write_files(annotated: DataFrame, path: str) -> None:
    """One folder ``name=...`` a file under ``path``, with its xml as text; files with an error are listed under ``_errors`` beside them."""
    kept = annotated.where("xml IS NOT NULL")
    kept.select("xml", "name").write.partitionBy("name").text(path)
    annotated.where("xml IS NULL").select("name", "error").write.json(f"{path.rstrip('/')}_errors")
