"""Readers: corpora as XML, CoNLL or text, dictionaries, and tagged lines."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.rows import let, opened

#: Attributes of known XML layouts that hold a token's form, lemma and part of speech (fixed values).
COMMON = {"sentence": "S", "form": None, "lemma": "LEMMA", "postag": "MSD"}
TREEBANK = {"sentence": "sentence", "form": "form", "lemma": "lemma", "postag": "postag"}
#: Names of sentence elements and of form attributes that are looked for (fixed values).
SENTENCE_TAGS = ("S", "s", "SENTENCE", "Sentence", "sentence", "SENT", "Sent", "sent")
FORM_NAMES = ("form", "word", "wordform")
_PARSED = "kind string, sid long, tid int, start int, end int, name string, form string, ref string, start_ref string, end_ref string, features map<string,string>"


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def sentence_tag(root: ET.Element) -> str:
    """The one known sentence element that has at least as many leaves as elements; none or several are an error."""
    found = []
    for tag in SENTENCE_TAGS:
        elements = [e for e in root.iter() if _local(e.tag) == tag]
        leaves = {id(x) for e in elements for x in e.iter() if x is not e and not len(x)}
        if elements and len(leaves) >= len(elements):
            found.append(tag)
    if len(found) != 1:
        raise ValueError(f"sentence elements: {', '.join(found) or 'none'}")
    return found[0]


def parse_corpus(xml: str, tag: str | None) -> Iterator[tuple]:
    """Rows of one document: sentences, tokens (leaf elements), inline spans (elements around tokens) and stand-off spans.

    Without ``tag`` it is inferred. A text that is no XML, or whose format is not clear, gives one row of kind ``error`` with the reason as its name.
    """
    try:
        root = ET.fromstring(xml)
        tag = tag or sentence_tag(root)
    except (ET.ParseError, ValueError) as reason:
        yield "error", None, None, None, None, str(reason), "xml" if isinstance(reason, ET.ParseError) else "format", None, None, None, {}
        return
    sid = 0
    for element in root.iter():
        if _local(element.tag) == tag:
            spans, n = [], 0

            def walk(node: ET.Element) -> Iterator[tuple]:
                nonlocal n
                for child in node:
                    marks = {_local(k): v for k, v in child.attrib.items()}
                    ref = marks.pop("RefId", None)
                    if len(child):
                        first = n
                        yield from walk(child)
                        spans.append(("span", sid, None, first, n - 1, _local(child.tag), None, None, None, None, marks))
                    else:
                        yield "token", sid, n, None, None, _local(child.tag), (child.text or "").strip() or None, ref, None, None, marks
                        n += 1

            marks = {_local(k): v for k, v in element.attrib.items()}
            tokens = list(walk(element))
            yield "sentence", sid, None, 0, n, tag, None, None, None, None, marks
            yield from tokens
            yield from spans
            sid += 1
        elif _local(element.tag) in ("SpanAnnotation", "Annotation"):
            marks = {_local(k): v for k, v in element.attrib.items()}
            ends = [marks.pop(k, None) for k in ("StartTokenRefId", "EndTokenRefId")]
            yield "stand-off", None, None, None, None, marks.pop("Name", None), None, None, *ends, marks


def parsed_xml(files: DataFrame, tag: str | None = None) -> DataFrame:
    """One row for each sentence, token, span and error of XML documents in ``files`` (``doc_id, text``), each parsed in the task that reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", *(c.split()[0] for c in _PARSED.split(", "))]
        for batch in batches:
            rows = [(doc, *row) for doc, xml in zip(batch["doc_id"], batch["text"], strict=True) if xml for row in parse_corpus(xml, tag)]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("sid", "tid", "start", "end"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, " + _PARSED)


#: Sentences of one task's share of a file; a file of up to 2^39 bytes is numbered.
_SHARE = 1 << 24


def split_xml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The rows of ``parsed_xml`` for XML files of any size: files are split at the ends of sentence elements (``tag``), so that many tasks read one file and none holds more than a sentence.

    ``sid`` follows the order of the sentences in their file, but is not dense: the place of the task's share in the file, and a count within it. Around sentences
    only stand-off annotations are read, from their attributes. A sentence that is no XML is an error row and the others go on. Sentences do not nest; files are UTF-8, without an end tag of a sentence in comments or CDATA.
    """
    end = f"</{tag}>"
    pieces = spark.read.option("lineSep", end).text(path).select(
        F.xxhash64(F.input_file_name()).alias("doc_id"), (F.col("_metadata.file_block_start") * _SHARE + F.pmod(F.monotonically_increasing_id(), F.lit(_SHARE))).alias("at"), "value"
    )
    sentence = F.regexp_extract("value", rf"(?s)\A.*(<(?:\w+:)?{re.escape(tag)}(?:\s[^>]*)?>.*)\z", 1)
    around = F.left("value", F.length("value") - F.length(sentence))
    marks = F.regexp_extract_all(around, F.lit(r"<(?:\w+:)?((?:Span)?Annotation\s[^>]*?)/?>"), F.lit(1))
    whole = F.concat(F.lit("<corpus>"), F.array_join(F.transform(marks, lambda m: F.concat(F.lit("<"), m, F.lit("/>"))), ""), F.when(sentence != "", F.concat(sentence, F.lit(end))).otherwise(""), F.lit("</corpus>"))
    some = pieces.where((F.instr("value", f"<{tag}") > 0) | F.contains("value", F.lit("Annotation")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", *(c.split()[0] for c in _PARSED.split(", "))]
        for batch in batches:
            rows = [(doc, kind, None if sid is None else at, *rest) for doc, at, xml in zip(batch["doc_id"], batch["at"], batch["text"], strict=True) for kind, sid, *rest in parse_corpus(xml, tag)]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("sid", "tid", "start", "end"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return some.select("doc_id", "at", whole.alias("text")).mapInPandas(run, "doc_id long, " + _PARSED)


def xml_corpus(files: DataFrame, layout: dict[str, str | None] = COMMON) -> dict[str, DataFrame]:
    """``sentences``, ``tokens``, ``spans`` and ``errors`` of XML documents in ``files`` (``doc_id, text``).

    A file that cannot be parsed is a row of errors and ends no job. Stand-off spans find their tokens by joins. Each table
    parses the files again; ``index_files`` parses them once.
    """
    return corpus_tables(parsed_xml(files, layout["sentence"]), layout)


def corpus_tables(rows: DataFrame, layout: dict[str, str | None]) -> dict[str, DataFrame]:
    from ..operators import spans as S

    held = lambda attribute: F.try_element_at("features", F.lit(attribute)) if attribute else F.lit(None).cast("string")
    before = Window.partitionBy("doc_id").orderBy("sid")
    found = rows.where("kind = 'sentence'").select("doc_id", "sid", F.col("end").alias("n_tok"), "features")
    sentences = found.select("doc_id", "sid", (F.sum("n_tok").over(before) - F.col("n_tok")).alias("first_tok"), "n_tok", "features")
    tokens = rows.where("kind = 'token'").select(
        "doc_id", "sid", "tid", F.coalesce(held(layout["form"]), "form").alias("form"), held(layout["lemma"]).alias("lemma"), held(layout["postag"]).alias("postag"), "ref", "features"
    )
    inline = rows.where("kind = 'span'").select("doc_id", "sid", "name", "start", "end", "features")
    refs = rows.where("kind = 'stand-off'").select("doc_id", "name", "start_ref", "end_ref", "features")
    spans = inline.withColumn("prefer_inline", F.lit(True)).unionByName(S.resolved_refs(refs, tokens).select(*inline.columns).withColumn("prefer_inline", F.lit(False)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sid", "start", F.desc("end"), "name", "prefer_inline")) - 1
    errors = rows.where("kind = 'error'").select("doc_id", F.col("form").alias("kind"), F.col("name").alias("reason"))
    return {"sentences": sentences, "tokens": tokens, "spans": spans.withColumn("span_id", number.cast("long")), "errors": errors}


#: The tables of a persisted corpus.
TABLES = ("sentences", "tokens", "spans", "errors")


def write_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """A corpus as Parquet, a folder for each table."""
    for name in TABLES:
        if name in tables:
            tables[name].write.parquet(f"{path}/{name}")


def open_corpus(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def index_files(files: DataFrame, path: str, layout: dict[str, str | None] | None = None) -> dict[str, DataFrame]:
    """Files (``doc_id, text``) parsed once and kept as a corpus under ``path``.

    Without a ``layout`` each file's sentence element is inferred, and the names of its attributes from all files. A file that is no XML, but holds
    lines of ten columns, is read as CoNLL; its columns are the tokens' features. Any other one, as a broken XML file, is an error row.
    """
    spark = files.sparkSession
    parsed_xml(files, layout and layout["sentence"]).write.parquet(f"{path}/parsed")
    rows = spark.read.parquet(f"{path}/parsed")
    if layout is None:
        layout = {"form": None, "lemma": None, "postag": None} | inferred_roles(rows.where("kind = 'token'")).first().asDict()
    tables = corpus_tables(rows, layout)
    others = files.join(tables["errors"].where("kind = 'xml'").select("doc_id"), "doc_id", "left_semi").where(is_conll(F.col("text")))
    lines = conll(others)
    features = F.map_filter(F.create_map(*(c for k in schema.CONLLU for c in (F.lit(k), F.col(k)))), lambda _, v: v.isNotNull())
    tokens = lines.select("doc_id", "sid", F.col("tid").cast("int"), "form", "lemma", F.col("xpostag").alias("postag"), F.lit(None).cast("string").alias("ref"), features.alias("features"))
    sizes = lines.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).cast("int").alias("n_tok"))
    first = (F.sum("n_tok").over(Window.partitionBy("doc_id").orderBy("sid")) - F.col("n_tok")).alias("first_tok")
    tables["tokens"] = tables["tokens"].unionByName(tokens)
    tables["sentences"] = tables["sentences"].unionByName(sizes.select("doc_id", "sid", first, "n_tok", F.lit(None).cast("map<string,string>").alias("features")))
    tables["errors"] = tables["errors"].join(lines.select("doc_id").distinct(), "doc_id", "left_anti")
    write_corpus(tables, path)
    return open_corpus(spark, path)


def inferred_roles(tokens: DataFrame) -> DataFrame:
    """One row of attribute names: ``form`` (of the known names the one with most values), ``lemma`` (most values of the others), ``postag``, ``deprel`` and, of numeric ones, ``head``.

    The last three have the number of values nearest to what such an attribute has in a treebank; ties go to the first name.
    """
    entries = tokens.select(F.explode(F.map_entries("features")).alias("e")).select("e.key", "e.value")
    counts = entries.groupBy("key").agg(F.countDistinct("value").alias("n"), F.bool_and(F.col("value").rlike(r"\A[0-9]+\z")).alias("numeric"))

    def nearest(target: int | None, numeric: bool, role: str) -> Column:
        distance = -F.col("n") if target is None else F.abs(F.col("n") - target)
        return F.min_by(F.when(F.col("numeric") == numeric, F.col("key")), F.when(F.col("numeric") == numeric, F.struct(distance.alias("d"), "key"))).alias(role)

    named = F.lower("key").isin(*FORM_NAMES)
    form = F.min_by(F.when(named, F.col("key")), F.when(named, F.struct((-F.col("n")).alias("d"), "key"))).alias("form")
    forms = counts.agg(form)
    counts = counts.where(~named)
    return forms.crossJoin(counts.agg(nearest(None, False, "lemma"), nearest(400, False, "postag"), nearest(50, False, "deprel"), nearest(10, True, "head")))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text`` of each file under a path; the number comes from the path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def _conll_lines(block: Column) -> Column:
    """The token lines of some lines: not blank, no comment, no range or empty node."""
    lines = F.transform(F.split(block, r"\r?\n"), T.without_bom)
    return F.filter(lines, lambda v: (F.trim(v) != "") & ~F.startswith(v, F.lit("#")) & ~F.substring_index(v, "\t", 1).rlike(r"[-.]"))


def is_conll(text: Column) -> Column:
    """Whether a text is CoNLL lines: some token line, and ten columns in each."""
    lines = _conll_lines(text)
    return let(lines, lambda ls: (F.size(ls) > 0) & F.forall(ls, lambda v: F.size(F.split(v, "\t")) == len(schema.CONLLU)))


def conll(files: DataFrame) -> DataFrame:
    """``doc_id, sid, tid`` and the ten CoNLL-U columns; blank lines part sentences, ``#`` lines and ranges are left out. Row by row, without a shuffle."""
    blocks = F.transform(F.split("text", r"\r?\n(?:[ \t]*\r?\n)+"), _conll_lines)
    sentences = opened(files, ("doc_id",), F.filter(blocks, lambda ls: F.size(ls) > 0), "lines", at="sid")
    tokens = opened(sentences, ("doc_id", F.col("sid").cast("long").alias("sid")), "lines", "value", at="tid").withColumn("cells", F.split("value", "\t"))
    cell = [F.nullif(F.get("cells", F.lit(k)), F.lit("_")).alias(c) for k, c in enumerate(schema.CONLLU)]
    return tokens.select("doc_id", "sid", "tid", *cell)


PRIORITIES = "###LexemPriorityTable"


def dictionary(files: DataFrame) -> dict[str, DataFrame]:
    """``entries`` (word, msd, lemma, extra) and ``frequency`` (lemma, freq) of compiled dictionaries in ``files``."""
    lines = files.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "value")).withColumn("value", T.without_bom(F.col("value"))).where("value <> ''")
    marked = lines.withColumn("after", F.max((F.col("value") == PRIORITIES).cast("int")).over(Window.partitionBy("doc_id").orderBy("line")))
    cells = F.split("value", "\t")
    words = marked.where("after = 0").select(F.element_at(cells, 1).alias("word"), F.explode(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).alias("e"))
    parts = F.split("e", "_", 3)
    entries = words.select("word", F.get(parts, F.lit(0)).alias("msd"), F.get(parts, F.lit(1)).alias("lemma"), F.get(parts, F.lit(2)).alias("extra"))
    rest = marked.where(F.col("after") == 1).where(F.col("value") != PRIORITIES)
    return {"entries": entries, "frequency": rest.select(F.element_at(cells, 1).alias("lemma"), F.get(cells, F.lit(1)).cast("int").alias("freq"))}


def entry_lines(lines: DataFrame) -> DataFrame:
    """Entries of ``word<TAB>LEMMA=..<TAB>MSD=..[<TAB>extra]`` lines (``value``); ``#`` lines are comments."""
    cells = F.split("value", "\t")
    kept = lines.where("NOT value LIKE '#%' AND value LIKE '%\t%'")
    part: Column = F.get(cells, F.lit(3))
    return kept.select(F.get(cells, F.lit(0)).alias("word"), F.regexp_extract("value", r"\tMSD=([^\t]*)", 1).alias("msd"), F.regexp_extract("value", r"\tLEMMA=([^\t]*)", 1).alias("lemma"), part.alias("extra"))


def tagged_lines(lines: DataFrame) -> DataFrame:
    """``line, tid, form, tag`` of ``word_TAG word_TAG`` lines (``line, value``); the last underscore divides."""
    opened = lines.select("line", F.posexplode(F.split(F.trim(T.without_bom(F.col("value"))), r"\s+")).alias("tid", "item")).where("item <> ''")
    return opened.select("line", "tid", F.regexp_extract("item", r"^(.*)_[^_]*$", 1).alias("form"), F.regexp_extract("item", r"_([^_]*)$", 1).alias("tag"))


def manual_tagset(lines: DataFrame) -> DataFrame:
    """``msd``: distinct tags of a list with ``#`` comments."""
    tag = F.trim(F.regexp_replace(T.without_bom(F.col("value")), "#.*$", ""))
    return lines.select(tag.alias("msd")).where("msd <> ''").distinct()


def matching_tags(tagset: DataFrame, patterns: DataFrame) -> DataFrame:
    """Tags of ``tagset`` that one of the ``pattern`` rows matches whole; both are small lists."""
    return tagset.join(patterns, F.expr(r"msd rlike concat('\\A(?:', pattern, ')\\z')"), "left_semi")


def lemma_frequencies(lines: DataFrame) -> DataFrame:
    """``lemma, freq`` of ``lemma freq`` lines (``value``); ~ stands for a blank, empty lines and a byte order mark go."""
    parts = F.split(T.without_bom(F.col("value")), r"\s")
    return lines.where("trim(value) <> ''").select(F.replace(F.get(parts, F.lit(0)), F.lit("~"), F.lit(" ")).alias("lemma"), F.get(parts, F.lit(1)).try_cast("int").alias("freq"))


def word_lines(lines: DataFrame) -> DataFrame:
    """``line, tid, form`` of lines of words parted by white space (``line, value``)."""
    return lines.select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("tid", "form")).where("form <> ''")
