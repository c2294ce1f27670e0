"""Sentences and tokens with their places in the text, and tokens as a dictionary has them.

A sentence's tokens are chosen among overlapping candidates: words and signs, addresses that must not be broken, and units of several
words that a dictionary has. Words with inner hyphens that the dictionary does not have are cut into parts that it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import let, opened, sums_before
from ..sources.shared import written

SPANS = "array<struct<start:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,form:string>>"
#: A hyphenated word of more parts is left whole.
MOST_PARTS = 24
#: Units that are sent to the tasks; where a dictionary has more, sentences meet them by joins.
MOST_UNITS = 200_000


def segmented(docs: DataFrame, abbreviations: tuple[str, ...] = (), ambiguous: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sid, start, end, text``: each text's sentences (``T.segments``), numbered from 0 across its paragraphs, with their place in it. Row by row."""
    found = opened(docs, (F.col(id_col).alias("doc_id"),), T.segments(F.col(text_col), abbreviations, ambiguous), "s", at="sid")
    return found.select("doc_id", F.col("sid").cast("long").alias("sid"), "s.start", (F.col("s.start") + F.length("s.text")).alias("end"), "s.text")


def unified(candidates: Column) -> Column:
    """Overlapping spans as disjoint ones, from the left: of two that overlap, those with one start or one end become one, else the later one goes."""
    state = F.struct(F.array().cast(SPANS).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        apart = c["start"] >= acc["end"]
        joins = (c["start"] == acc["start"]) | (c["end"] == acc["end"])
        held = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
        return F.struct(
            F.when(apart & (acc["end"] >= 0), F.array_append(acc["done"], held)).otherwise(acc["done"]).alias("done"),
            F.when(apart, c["start"]).otherwise(acc["start"]).alias("start"),
            F.when(apart, c["end"]).when(joins, F.greatest(acc["end"], c["end"])).otherwise(acc["end"]).alias("end"),
        )

    last = lambda acc: F.when(acc["end"] >= 0, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))).otherwise(acc["done"])
    return F.aggregate(F.array_sort(candidates), state, step, last)


def _canonical_tiles(text: Column, tiles: Column) -> Column:
    """The tiles in the dictionary's spelling, blanks as ~: those of the whole canonical text, unless lower case changed their number."""
    whole = T.unit_tiles(T.canonical_word(text))
    each = F.transform(tiles, lambda t: F.when(t.rlike(r"\A[\s\p{Z}]"), "~").otherwise(T.canonical_word(t)))
    return let(whole, lambda w: F.when(F.size(w) == F.size(tiles), w).otherwise(each))


def _unit_keys(dictionary: DataFrame, longest: int) -> DataFrame:
    """``n, word_key, stopped``: the dictionary's units of two to ``2 * longest - 1`` tiles, and whether each ends with a full stop and is known without it."""
    keys = dictionary.select("word_key").distinct().withColumn("n", F.size(T.unit_tiles(F.col("word_key")))).where((F.col("n") > 1) & (F.col("n") < 2 * longest))
    bare = dictionary.select(F.col("word_key").alias("without")).distinct().withColumn("known", F.lit(True))
    stopped = keys.withColumn("without", F.when(F.endswith("word_key", F.lit(".")), F.regexp_replace("word_key", r"\.\z", ""))).join(bare, "without", "left")
    return stopped.select("n", "word_key", F.coalesce("known", F.lit(False)).alias("stopped"))


def units_in(rows: DataFrame, dictionary: DataFrame, longest: int = 8) -> DataFrame | None:
    """``rows`` with the ``units`` (as in ``unit_spans``) of their ``text``, found in the row itself by units that are sent to all tasks; None where there are more than ``MOST_UNITS``."""
    keys = _unit_keys(dictionary, longest).limit(MOST_UNITS + 1).collect()
    if len(keys) > MOST_UNITS:
        return None
    by_size = {n: [(r["word_key"], r["stopped"]) for r in keys if r["n"] == n] for n in sorted({r["n"] for r in keys})}
    held = rows.sparkSession.sparkContext.broadcast(by_size)

    def found(tiles: pa.Array, canonical: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(tiles), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words, flat = tiles.flatten(), canonical.flatten()
        ends = np.repeat(np.cumsum(n), n)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        first = np.repeat(at[np.cumsum(n) - n], n)
        open_ = np.flatnonzero(~pc.equal(flat, "~").to_numpy(zero_copy_only=False)) if len(flat) else np.empty(0, np.int64)
        length, stopped = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
        # Longer units are found later and count.
        for k, own in held.value.items():
            some = open_[open_ + k <= ends[open_]]
            parts = [flat.take(pa.array(some + j)) for j in range(k)]
            index = pc.index_in(pc.binary_join_element_wise(*parts, "") if len(some) else flat.slice(0, 0), value_set=pa.array([w for w, _ in own], pa.string()))
            hits, which = some[index.is_valid().to_numpy(zero_copy_only=False)], index.drop_null().to_numpy()
            length[hits], stopped[hits] = k, np.array([x for _, x in own], bool)[which]
        places = np.flatnonzero(length > 0)
        places = places[~(stopped[places] & (places + length[places] == ends[places]))]
        spans = pa.StructArray.from_arrays([pa.array(at[places] - first[places], pa.int32()), pa.array(at[places + length[places]] - first[places], pa.int32())], names=["start", "end"])
        offsets = np.searchsorted(places, np.concatenate([[0], np.cumsum(n)]))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    cut = rows.withColumn("tiles", F.regexp_extract_all("text", F.lit(T.TILE), F.lit(0)))
    keyed = cut.withColumn("canonical", _canonical_tiles(F.col("text"), F.col("tiles")))
    return keyed.withColumn("units", F.arrow_udf(found, SPANS)("tiles", "canonical")).drop("tiles", "canonical")


def unit_spans(sentences: DataFrame, dictionary: DataFrame, longest: int = 8) -> DataFrame:
    """``doc_id, sid, units``: for each place in a sentence the longest unit of two tiles or more (words, signs, blanks) that the dictionary has, as ``start, end``.

    ``dictionary`` holds ``word_key``; keys of up to ``longest`` words take part. Places and keys meet by the first three tiles (of keys of two tiles, by these), so that a frequent
    first word alone meets nothing; what is met goes back to its sentence, where the rest is compared. A unit that ends with the sentence's full stop and is
    known without it is left out.
    """
    stopped, tiles = _unit_keys(dictionary, longest), T.unit_tiles(F.col("word_key"))
    beginning = F.array_join(F.slice(tiles, F.lit(1), F.least(F.lit(3), F.col("n"))), "")
    grouped = stopped.groupBy(beginning.alias("beginning")).agg(F.collect_set(F.struct("n", "word_key", "stopped")).alias("keys"))
    cut = sentences.select("doc_id", "sid", "text", F.regexp_extract_all("text", F.lit(T.TILE), F.lit(0)).alias("tiles"))
    keyed = cut.where(F.size("tiles") > 1).select("doc_id", "sid", "tiles", _canonical_tiles(F.col("text"), F.col("tiles")).alias("canonical"))
    later = lambda k, name: F.slice("canonical", k, F.size("canonical")).alias(name)
    runs = opened(keyed, ("doc_id", "sid"), F.arrays_zip(F.col("canonical").alias("a"), later(2, "b"), later(3, "c")), "r", at="i")
    two = F.concat("r.a", "r.b")
    at = runs.where((F.col("r.a") != "~") & F.col("r.b").isNotNull()).select("doc_id", "sid", (F.col("i") + 1).alias("i"), F.explode(F.array(two, F.concat(two, "r.c"))).alias("beginning"))
    asked = at.where(F.col("beginning").isNotNull())
    met = asked.join(grouped, "beginning").groupBy("doc_id", "sid").agg(F.collect_list(F.struct("i", "keys")).alias("met"))
    held = keyed.join(met, ["doc_id", "sid"]).withColumn("starts", sums_before(F.transform("tiles", F.length)))
    fits = lambda m: F.filter(m["keys"], lambda k: F.array_join(F.slice("canonical", m["i"], k["n"]), "") == k["word_key"])
    found = F.filter(F.transform("met", lambda m: F.struct(m["i"].alias("i"), F.array_max(fits(m)).alias("k"))), lambda m: m["k"].isNotNull())
    # Keys of two tiles and of more meet a place apart: the longest of both.
    best = F.map_from_entries(F.transform(F.array_distinct(F.transform(found, lambda m: m["i"])), lambda i: F.struct(i.alias("key"), F.array_max(F.transform(F.filter(found, lambda m: m["i"] == i), lambda m: m["k"])).alias("value"))))
    last = lambda e: e["key"] + e["value"]["n"] - 1
    kept = lambda es: F.filter(es, lambda e: ~(e["value"]["stopped"] & (last(e) == F.size("tiles"))))
    span = lambda e: F.struct(F.element_at("starts", e["key"]).cast("int").alias("start"), (F.element_at("starts", last(e)) + F.length(F.element_at("tiles", last(e)))).cast("int").alias("end"))
    return held.withColumn("best", F.map_entries(best)).select("doc_id", "sid", F.transform(kept(F.col("best")), span).alias("units"))


def hyphen_parts(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``word, parts`` of distinct hyphenated words that are cut: ``parts`` one after the other are the word.

    ``dictionary`` holds ``word_key`` and ``freq``, how frequent the lemmas of its readings are together. First the longest run of four, three or two parts that the dictionary has as
    a whole, from the left, becomes one part. Then each hyphen goes to the part before it or after it, such that most tokens are known (those with a
    hyphen at an end count ten), next such that their frequencies (unknown: -100) add up to most, next such that hyphens stay with the earlier part, the last ones first.
    A word whose frequencies add up to nothing stays whole, as one that the dictionary has. All choices are weighed in one fold over the parts, not one by one.
    """
    split = words.select("word").distinct().where(F.expr("length(word) > 2 AND instr(substr(word, 2, length(word) - 2), '-') > 0")).withColumn("cut", F.split("word", "-"))
    # Empty parts at the end fall away, as the hyphens there.
    trimmed = split.withColumn("cut", F.split(F.regexp_replace("word", r"-+\z", ""), "-")).where((F.size("cut") > 1) & (F.size("cut") <= MOST_PARTS))
    n = F.size("cut")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), n - i + 1)), lambda k: F.array_join(F.slice("cut", i, k), "-"))))
    sides = F.flatten(F.transform(runs, lambda r: F.array(r, F.concat(F.lit("-"), r), F.concat(r, F.lit("-")), F.concat(F.lit("-"), r, F.lit("-")))))
    asked = opened(trimmed, ("word", "cut"), F.array_distinct(F.array_append(sides, F.col("word"))), "form").withColumn("word_key", T.canonical_word(F.col("form")))
    known = dictionary.groupBy("word_key").agg(F.sum("freq").alias("freq"))
    held = asked.join(known, "word_key").groupBy("word", "cut").agg(F.map_from_entries(F.collect_list(F.struct("form", F.col("freq").cast("long")))).alias("held"))
    open_words = held.where(~F.map_contains_key("held", F.col("word")))
    has = lambda form: F.map_contains_key("held", form)
    run = lambda i, k: F.array_join(F.slice("cut", i, k), "-")
    # The first group of the largest size, if any: (place, size).
    sized = lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: (i + k - 1 <= n) & (has(run(i, F.lit(k))) | has(F.concat(F.lit("-"), run(i, F.lit(k)))) | has(F.concat(run(i, F.lit(k)), F.lit("-"))))), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k")))  # noqa: E731, E501
    grouped = open_words.withColumn("group", F.get(F.concat(sized(4), sized(3), sized(2)), F.lit(0)))
    merged = F.concat(F.slice("cut", F.lit(1), F.col("group.i") - 1), F.array(run(F.col("group.i"), F.col("group.k"))), F.slice("cut", F.col("group.i") + F.col("group.k"), n))
    parts = grouped.select("word", "held", F.when(F.col("group").isNull(), F.col("cut")).otherwise(merged).alias("ps"))
    # Two best ways so far: the hyphen after the part goes to it, or to the next one. Ways compare by known tokens, frequency, and their code, the smaller one first.
    way = "struct<score:bigint,freq:bigint,code:bigint,tokens:array<string>>"
    none = F.lit(None).cast(way)

    def extended(before: Column, form: Column, bit: Column | int, i: Column) -> Column:
        known_form = has(form)
        ends = F.startswith(form, F.lit("-")) | F.endswith(form, F.lit("-"))
        return F.when(before.isNotNull(), F.struct(
            (before["score"] + F.when(known_form, F.when(ends, 10).otherwise(1)).otherwise(0)).alias("score"),
            (before["freq"] + F.coalesce(F.element_at("held", form), F.lit(-100))).alias("freq"),
            (before["code"] - F.lit(bit) * F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), i).cast("long")).cast("long").alias("code"),
            F.array_append(before["tokens"], form).alias("tokens"),
        ).cast(way))

    better = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).when(F.struct(a["score"], a["freq"], a["code"]) >= F.struct(b["score"], b["freq"], b["code"]), a).otherwise(b)
    first = F.struct(F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("freq"), F.lit(0).cast("long").alias("code"), F.array().cast("array<string>").alias("tokens")).cast(way).alias("own"), none.alias("next"), F.lit(0).alias("i"))

    def fold(acc: Column, part: Column) -> Column:
        last = acc["i"] == F.size("ps") - 1
        dash = F.lit("-")
        to_own = better(extended(acc["own"], F.concat(part, dash), 0, acc["i"]), extended(acc["next"], F.concat(dash, part, dash), 0, acc["i"]))
        to_next = better(extended(acc["own"], part, F.when(last, 0).otherwise(1), acc["i"]), extended(acc["next"], F.concat(dash, part), F.when(last, 0).otherwise(1), acc["i"]))
        return F.struct(F.when(~last, to_own).alias("own"), to_next.alias("next"), (acc["i"] + 1).alias("i"))

    chosen = parts.select("word", F.aggregate("ps", first, fold)["next"].alias("w"))
    # Hyphens at the word's end stay with its last token.
    tail = F.regexp_extract("word", r"-+\z", 0)
    tokens = F.concat(F.slice("w.tokens", F.lit(1), F.size("w.tokens") - 1), F.array(F.concat(F.element_at("w.tokens", -1), tail)))
    return chosen.where("w.freq > 0").select("word", tokens.alias("parts")).where(F.size("parts") > 1)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences whose ``parts`` follow each other get their ``tokens``, all parts but blanks with their places, a batch at once; the others have them."""
    for batch in batches:
        kind = batch.schema.field(5).type
        schema = pa.schema([batch.schema.field(k) for k in (0, 1, 2, 3, 5)])
        plain = batch.column(4).is_valid()
        for part, located in ((batch.filter(plain), True), (batch.filter(pc.invert(plain)), False)):
            if part.num_rows and not located:
                yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(5)], schema=schema)
            elif part.num_rows:
                n, flat = pc.list_value_length(part.column(4)).to_numpy().astype(np.int64), part.column(4).flatten()
                sizes, first = pc.utf8_length(flat).to_numpy().astype(np.int64), np.cumsum(n) - n
                at = np.concatenate([[0], np.cumsum(sizes)])
                starts = at[:-1] - np.repeat(at[first], n)
                word = ~pc.match_substring_regex(flat, r"^[\s\x0B\p{Z}]").to_numpy(zero_copy_only=False)
                kept = np.concatenate([[0], np.cumsum(word)])
                place = lambda x, word=word: pa.array(x[word], pa.int32())
                tokens = pa.StructArray.from_arrays([place(starts), place(starts + sizes), flat.filter(pa.array(word))], fields=list(kind.value_type))
                offsets = pa.array(np.append(kept[first], kept[-1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(offsets, tokens, type=kind)], schema=schema)


def tokenized(sentences: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``doc_id, sid, tid, form, start, end`` of the columns ``doc_id, sid, start, text``: tokens with their places in the document's text.

    Candidates are words and signs, nonbreakable addresses, and, with a dictionary (``word_key, freq``), its units; they are made disjoint by
    ``unified``. Words with an inner hyphen that are unknown and do not begin with an address are cut by ``hyphen_parts``, computed once for each distinct word. Without a dictionary there is no
    shuffle. With one, units are looked up in the sentence's own row (beyond ``MOST_UNITS`` of them sentences are written to the shared folder and meet their units by their number); the tokens are
    written there, since hyphenated words are read first, and only sentences that have some meet their parts.
    """
    text = F.col("text")
    rows = sentences.select("doc_id", "sid", "start", "text")
    if dictionary is None:
        rows = rows.withColumn("units", F.array().cast(SPANS))
    else:
        dictionary = written(dictionary.select("word_key", "freq"))
        if (held := units_in(rows, dictionary)) is None:
            kept = written(rows)
            held = kept.join(unit_spans(kept, dictionary), ["doc_id", "sid"], "left").withColumn("units", F.coalesce("units", F.array().cast(SPANS)))
        rows = held
    rows = rows.select("doc_id", "sid", F.col("start").alias("from_"), "text", T.nonbreakable_spans(text).alias("whole"), "units")
    # Nearly all sentences have words and signs alone, which follow each other; only in the others candidates overlap.
    more = F.concat("whole", "units")
    form = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substr("text", s["start"] + 1, s["end"] - s["start"]).alias("form"))
    tokens = F.when(F.size(more) > 0, F.transform(unified(F.concat(T.word_spans(text), more)), form))
    rows = rows.select("doc_id", "sid", "from_", F.transform("whole", lambda w: w["start"]).alias("fixed"), F.when(F.size(more) == 0, T.word_parts(text)).alias("parts"), tokens.alias("tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.mapInArrow(_located, f"doc_id {kinds['doc_id']}, sid {kinds['sid']}, from_ {kinds['from_']}, fixed array<int>, tokens {TOKENS}")
    if dictionary is not None:
        rows = _resplit(rows, dictionary)
    found = opened(rows, ("doc_id", "sid", "from_"), "tokens", "t", at="tid")
    return found.select("doc_id", "sid", "tid", "t.form", (F.col("from_") + F.col("t.start")).alias("start"), (F.col("from_") + F.col("t.end")).alias("end"))


def _resplit(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, sid, from_, tokens`` with the tokens with hyphens cut into their parts."""
    asks = F.filter("tokens", lambda t: t["form"].rlike(r"\A.+-.+\z") & ~F.array_contains("fixed", t["start"]))
    # A token ends where its form does, so its end is not written.
    kept = written(rows.select("doc_id", "sid", "from_", F.transform(asks, lambda t: t["start"]).alias("cuts"), F.col("tokens.start").alias("starts"), F.col("tokens.form").alias("forms")), "zstd")
    tokens = F.zip_with("starts", "forms", lambda at, w: F.struct(at.alias("start"), (at + F.length(w)).alias("end"), w.alias("form")))
    rows = kept.select("doc_id", "sid", "from_", "cuts", tokens.cast(TOKENS).alias("tokens"))
    plain, cut = rows.where("size(cuts) <= 0 OR cuts IS NULL").drop("cuts"), rows.where("size(cuts) > 0")
    words = F.transform(F.filter("tokens", lambda t: F.array_contains("cuts", t["start"])), lambda t: t["form"])
    asked = opened(cut, ("doc_id", "sid"), words, "word").distinct()
    parts = asked.join(hyphen_parts(asked, dictionary), "word").groupBy("doc_id", "sid").agg(F.map_from_entries(F.collect_list(F.struct("word", "parts"))).alias("parts"))
    met = cut.join(parts, ["doc_id", "sid"], "left")

    def opened_token(t: Column) -> Column:
        ps = F.when(F.array_contains("cuts", t["start"]), F.try_element_at("parts", t["form"]))
        return F.when(ps.isNull(), F.array(t)).otherwise(F.zip_with(ps, T.starts(ps), lambda p, at: F.struct((t["start"] + at).cast("int").alias("start"), (t["start"] + at + F.length(p)).cast("int").alias("end"), p.alias("form"))))

    tokens = F.when(F.col("parts").isNull(), F.col("tokens")).otherwise(F.flatten(F.transform("tokens", opened_token)))
    return plain.unionByName(met.select("doc_id", "sid", "from_", tokens.alias("tokens")))
