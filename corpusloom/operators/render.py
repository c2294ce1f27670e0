"""Corpora and dictionaries as text again."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.rows import let
from . import spans as S


def sentence_xml(forms: list[str], features: list[dict], spans: list[tuple[str, int, int, dict]], marks: dict, refs: list[str | None] | None = None) -> str:
    """One sentence element; spans that nest are elements around their tokens (longer ones outside), and tokens that stand-off spans name have a ``RefId``."""
    text = lambda d: "".join(f" {k}={quoteattr(v or '')}" for k, v in sorted(d.items()))
    opens: dict[int, list] = {}
    for name, start, end, own in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        opens.setdefault(start, []).append((name, end, own))
    out, stack = [f"<S{text(marks)}>"], []
    for k, (form, own) in enumerate(zip(forms, features, strict=True)):
        for name, end, marks_of in opens.get(k, []):
            out.append(f"<{name}{text(marks_of)}>")
            stack.append((name, end))
        named = own | {"RefId": refs[k]} if refs and refs[k] else own
        out.append(f"<W{text(named)}>{escape(form or '')}</W>")
        while stack and stack[-1][1] == k:
            out.append(f"</{stack.pop()[0]}>")
    if stack:
        raise ValueError("spans cross or end beyond the sentence")
    return "".join(out) + "</S>"


MODES = ("inline", "standoff", "preserve", "optimal", "auto")


def inline_spans(spans: DataFrame, mode: str) -> DataFrame:
    """The spans of each document that are written as elements; the others are written stand-off.

    ``inline``: all; ``standoff``: none; ``preserve``: all where all nest, else those that prefer it; ``optimal``: all where all nest, else a largest
    set that nests; ``auto``: all where all nest, else those that prefer it where there are some and these nest, else the optimal set.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    if mode in ("inline", "standoff"):
        return spans.where(F.lit(mode == "inline"))
    crossed = S.crossing(spans).select("doc_id").distinct()
    whole, rest = spans.join(crossed, "doc_id", "left_anti"), spans.join(crossed, "doc_id", "left_semi")
    preferred = rest.where("prefer_inline")
    if mode == "preserve":
        return whole.unionByName(preferred)
    if mode == "auto":
        crossing_still = S.crossing(preferred).select("doc_id").distinct()
        good = preferred.select("doc_id").distinct().join(crossing_still, "doc_id", "left_anti")
        whole = whole.unionByName(preferred.join(good, "doc_id", "left_semi"))
        rest = rest.join(good, "doc_id", "left_anti")
    return whole.unionByName(S.nestable(rest))


def corpus_xml(tokens: DataFrame, spans: DataFrame, mode: str = "inline") -> DataFrame:
    """``doc_id, sid, xml, error``: each sentence rendered, with its spans as elements or after it as stand-off elements, by ``mode``.

    Groups are single sentences. A sentence whose spans cannot be written as ``mode`` asks has no xml and a reason in ``error``.
    """
    words = tokens.groupBy("doc_id", "sid").agg(
        F.sort_array(F.collect_list(F.struct("tid", "form", F.to_json("features").alias("features")))).alias("words")
    )
    chosen = spans if mode == "inline" else spans.join(inline_spans(spans, mode).select("doc_id", "sid", "span_id").withColumn("nested", F.lit(True)), ["doc_id", "sid", "span_id"], "left")
    nested = F.lit(True) if mode == "inline" else F.coalesce("nested", F.lit(False))
    around = chosen.groupBy("doc_id", "sid").agg(F.collect_list(F.struct("name", "start", "end", F.to_json("features").alias("features"), nested.alias("nested"))).alias("spans"))

    @F.pandas_udf("struct<xml:string,error:string>")
    def render(doc: pd.Series, sid: pd.Series, words: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for d, s, ws, ss in zip(doc, sid, words, spans, strict=True):
            ss = [] if ss is None else list(ss)
            inside, outside = ([(x["name"], x["start"], x["end"], json.loads(x["features"] or "{}")) for x in ss if x["nested"] == kind] for kind in (True, False))
            named = {k for _, a, b, _ in outside for k in (a, b)}
            ref = lambda k: f"{d}.{s}.{k}"  # noqa: B023, E731
            try:
                xml = sentence_xml([w["form"] for w in ws], [json.loads(w["features"] or "{}") for w in ws], inside, {}, [ref(k) if k in named else None for k in range(len(ws))])
                for name, a, b, own in sorted(outside, key=lambda x: (x[1], -x[2], x[0])):
                    marks = {"Name": name, "StartTokenRefId": ref(a), "EndTokenRefId": ref(b)} | own
                    xml += "<SpanAnnotation" + "".join(f" {k}={quoteattr(v or '')}" for k, v in marks.items()) + "/>"
                out.append((xml, None))
            except ValueError as reason:
                out.append((None, str(reason)))
        return pd.DataFrame(out, columns=["xml", "error"])

    return words.join(around, ["doc_id", "sid"], "left").select("doc_id", "sid", render("doc_id", "sid", "words", "spans").alias("x")).select("doc_id", "sid", "x.xml", "x.error")


def document_xml(sentences: DataFrame) -> DataFrame:
    """``doc_id, xml``: the rendered sentences of each document under one root, a sentence a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sid", "xml"))), lambda x: x["xml"])
    return sentences.groupBy("doc_id").agg(F.concat(F.lit("<corpus>\n"), F.array_join(lines, "\n"), F.lit("\n</corpus>")).alias("xml"))


def tagset_lines(entries: DataFrame) -> DataFrame:
    """``msd``: the distinct tags, in order."""
    return entries.select("msd").distinct().orderBy("msd")


def dictionary_lines(entries: DataFrame) -> DataFrame:
    """``value``: one line a word with its entries, as the dictionary reader takes them."""
    entry = F.concat_ws("_", "msd", "lemma", "extra")
    return entries.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set(entry)), "\t").alias("e")).select(F.concat_ws("\t", "word", "e").alias("value"))


def tagged_text(tokens: DataFrame) -> DataFrame:
    """``doc_id, sid, value``: a sentence as ``word_lemma_tag[_extra]`` items; white space in a word is ~."""
    extra = [F.col("extra")] if "extra" in tokens.columns else []
    item = F.concat_ws("_", F.regexp_replace("form", r"\s+", "~"), "lemma", "postag", *extra)
    items = F.transform(F.array_sort(F.collect_list(F.struct("tid", item.alias("item")))), lambda x: x["item"])
    return tokens.groupBy("doc_id", "sid").agg(F.array_join(items, " ").alias("value"))


def tagged_json(tokens: DataFrame) -> DataFrame:
    """``doc_id, sid, value``: a sentence as a list of objects of its words' form, lemma and tag."""
    item = F.struct(F.col("form").alias("WORD"), F.col("lemma").alias("Lemma"), F.col("postag").alias("MSD"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("tid", item.alias("item")))), lambda x: x["item"])
    return tokens.groupBy("doc_id", "sid").agg(F.to_json(items).alias("value"))


def _escaped(value: Column) -> Column:
    out = value
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(written))
    return F.when(value.rlike('[&<>"]'), out).otherwise(value)


def _marks(entries: Column) -> Column:
    """Attributes by name, each once (of several the last), without null ones."""
    # In the elements' own order, which takes no comparison by a lambda.
    written = F.transform(F.sort_array(F.filter(entries, lambda e: e["value"].isNotNull())), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    return F.array_join(written, "")


def _mark_row(named: dict[str, Column]) -> Column:
    """``_marks`` of attributes whose names are known; their values come escaped."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f' {name}="'), named[name], F.lit('"')), F.lit("")) for name in sorted(named)))


def tagged_xml(tokens: DataFrame, language: str | None = None) -> DataFrame:
    """``doc_id, sid, xml``: each sentence as an ``S`` element of ``W`` elements, from ``doc_id, sid, tid, form, lemma, postag`` and, where there are such columns, ``extra``
    and ``start`` (a token's place in its text).

    A word has the attributes LEMMA, MSD, EXTRA and offset; with a ``language`` (en or ro) also what its tag says. Attributes stand in the order of their names; a sentence has its
    number as id and the place of its first word as offset. A null form is an empty one, null values are left out. One shuffle, by sentence.
    """
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    optional = {name: F.col(c).cast("string") for name, c in (("EXTRA", "extra"), ("offset", "start")) if c in tokens.columns}

    # The names that a tag's first letter brings are known, and so is their order: each letter's words are one concatenation.
    def marks(tag: Column) -> Column:
        own = {name: _escaped(v) for name, v in {"LEMMA": F.col("lemma").cast("string"), "MSD": tag, **optional}.items()}
        out = _mark_row(own)
        for letter in tags.LAYOUT if language is not None else ():
            out = F.when(tag.startswith(letter) & tag.rlike(tags.TELLING), _mark_row(tags.attributes(tag, letter, language) | own)).otherwise(out)
        return out

    word = F.concat(F.lit("<W"), let(F.col("postag").cast("string"), marks), F.lit(">"), _escaped(F.coalesce("form", F.lit(""))), F.lit("</W>"))
    start = F.col("start") if "start" in tokens.columns else F.lit(None).cast("int")
    held = tokens.groupBy("doc_id", "sid").agg(F.sort_array(F.collect_list(F.struct("tid", word.alias("xml")))).alias("words"), F.min(start).alias("offset"))
    inside = F.array_join(F.transform("words", lambda w: w["xml"]), "")
    about = _marks(F.array(entry("id", F.col("sid")), entry("offset", F.col("offset"))))
    return held.select("doc_id", "sid", F.concat(F.lit("<S"), about, F.lit(">"), inside, F.lit("</S>")).alias("xml"))
