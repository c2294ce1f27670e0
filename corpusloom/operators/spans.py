"""Operators on span annotations: ``doc_id, sid, span_id, name, start, end`` with both ends inclusive."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.rows import opened
from ..sources.shared import written

KEY = ["doc_id", "sid"]


def covering(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Each token with each span that covers it; spans are opened to positions so that the join has equal keys only."""
    places = spans.withColumn("tid", F.explode(F.sequence("start", "end")))
    return tokens.join(places, [*KEY, "tid"])


def covered(matches: DataFrame, forms: str = "forms") -> DataFrame:
    """``tid, form`` of each token that a match covers, from the sentence's own array kept beside the match: no join."""
    inside = opened(matches, tuple(c for c in matches.columns if c != forms), F.slice(forms, F.col("start") + 1, F.col("len")), "form", at="k")
    return inside.withColumn("tid", F.col("start") + F.col("k")).drop("k")


def crossing(spans: DataFrame) -> DataFrame:
    """``doc_id, sid, a, b``: pairs of spans of a sentence that overlap without nesting, the earlier one first.

    Each span is opened to the positions after its start, and spans that start there and end later cross it; so spans meet by
    (sentence, position), not all spans of a sentence.
    """
    places = spans.where("end > start").select(*KEY, F.col("span_id").alias("a"), F.col("end").alias("a_end"), F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("start"))
    other = spans.select(*KEY, "start", F.col("span_id").alias("b"), F.col("end").alias("b_end"))
    return places.join(other, [*KEY, "start"]).where("a_end < b_end").select(*KEY, "a", "b")


def crossing_degree(spans: DataFrame) -> DataFrame:
    """``doc_id, sid, span_id, degree``: how many spans cross each one that is crossed."""
    pairs = crossing(spans)
    both = pairs.select(*KEY, F.col("a").alias("span_id")).unionByName(pairs.select(*KEY, F.col("b").alias("span_id")))
    return both.groupBy(*KEY, "span_id").agg(F.count(F.lit(1)).alias("degree"))


def nestable(spans: DataFrame) -> DataFrame:
    """A largest set, greedily found, of spans that nest: the most crossed one goes first, ties by span_id.

    Sentences without a crossing, nearly all, pass by a join alone; only the others meet in a group each.
    """
    # Read four times, computed once.
    spans = written(spans)
    crossed = crossing(spans).select(*KEY).distinct()
    keep = spans.join(crossed, KEY, "left_anti")

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group.start, group.end, group.span_id, strict=True))
        met: dict[int, set[int]] = {i: set() for _, _, i in rows}
        for k, (a, b, i) in enumerate(rows):
            for c, d, j in rows[k + 1 :]:
                if c > b:
                    break
                if a < c and b < d:
                    met[i].add(j)
                    met[j].add(i)
        while any(met.values()):
            worst = max(met, key=lambda i: (len(met[i]), i))
            for j in met.pop(worst):
                met[j].discard(worst)
        return group[group.span_id.isin(met)]

    mended = spans.join(crossed, KEY, "left_semi").groupBy(*KEY).applyInPandas(resolve, spans.schema)
    return keep.unionByName(mended)


def _numbers(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _laid(spans: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows, ends and whether these are known, of arrays of structs."""
    ends = [pc.struct_field(spans.flatten(), k) for k in ("start", "end")]
    return np.repeat(np.arange(len(spans)), _numbers(pc.list_value_length(spans))), [_numbers(e) for e in ends], [e.is_valid().to_numpy(zero_copy_only=False) for e in ends]


def _inside(row: np.ndarray, ends: list[np.ndarray], gold: pa.Array) -> list[np.ndarray]:
    """For each of a span's ends whether it is inside a gold span of its row: it is searched among the sorted starts, so that no span meets each gold one."""
    gold_row, gold_ends, known = _laid(gold)
    both = known[0] & known[1]
    every = np.concatenate([*ends, *gold_ends, [0]])
    low, wide = every.min(), every.max() - every.min() + 1
    # Rows are laid one after the other, so that no span reaches into the next one.
    start, end = ((gold_row * wide + e - low)[both] for e in gold_ends)
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(np.append(-1, end[order]))
    places = (row * wide + e - low for e in ends)
    # Some span that starts up to here ends here or later.
    return [reach[np.searchsorted(start, at, side="right")] >= at for at in places]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _spans_meet(found: pa.Array, gold: pa.Array) -> pa.Array:
    row, ends, known = _laid(found)
    first, last = (inside & k for inside, k in zip(_inside(row, ends, gold), known, strict=True))
    return _lists(_numbers(pc.list_value_length(found)), pa.array(first | last))


def _cuts_meet(cuts: pa.Array, gold: pa.Array) -> pa.Array:
    sizes, flat = _numbers(pc.list_value_length(cuts)), _numbers(cuts.flatten())
    row, before = np.repeat(np.arange(len(cuts)), sizes), np.append(0, np.cumsum(flat))
    begins = np.cumsum(sizes) - sizes
    is_match = (np.arange(len(flat)) - begins[row]) % 2 == 1
    start = (before[:-1] - before[begins[row]])[is_match]
    row, ends = row[is_match], [start, start + flat[is_match] - 1]
    hit = np.logical_or(*_inside(row, ends, gold))
    return _lists(np.bincount(row[hit], minlength=len(cuts)), pa.StructArray.from_arrays([pa.array(e[hit]) for e in ends], ["start", "end"]))


def intersecting_cuts(sentences: DataFrame, cuts: str, gold: str) -> DataFrame:
    """``doc_id, sid, start, end``: matches that have an end inside a gold span, from sentences that hold both in their own row, without a shuffle.

    ``cuts`` are the matches as ``grammar.cuts`` gives them, ``gold`` is an array of structs with ``start, end``; only these numbers go to Python, a batch at once.
    """
    met = F.arrow_udf(_cuts_meet, "array<struct<start:bigint,end:bigint>>")(cuts, gold)
    return opened(sentences.select(*KEY, met.alias("met")), tuple(KEY), "met", "s").select(*KEY, "s.*")


def intersecting(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Found spans that have an end inside a gold span of their sentence. A sentence's spans meet once, not each with each."""
    held = found.groupBy(*KEY).agg(F.collect_list(F.struct(*(c for c in found.columns if c not in KEY))).alias("found"))
    known = gold.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("gold"))
    ends = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    both = held.join(known, KEY).select(*KEY, "found", F.arrow_udf(_spans_meet, "array<boolean>")(ends, "gold").alias("hit"))
    return opened(both, tuple(KEY), F.filter("found", lambda s, k: F.get("hit", k)), "s").select(*KEY, "s.*").select(*found.columns)


def differences(found: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, sid, start, end, kind``: spans only found (``false``) and only in gold (``missed``)."""
    keys = [*KEY, "start", "end"]
    # Each side is computed once; rows stay as often as they come, and a null equals nothing.
    both = found.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("f"), F.lit(1).alias("g")))
    counted = both.groupBy(keys).agg(F.sum("f").cast("int").alias("f"), F.sum("g").cast("int").alias("g"))
    apart = F.lit(False)
    for k in keys:
        apart = apart | F.col(k).isNull()
    alone = lambda kind, own, other: F.array_repeat(F.lit(kind), F.when(apart | (F.col(other) == 0), F.col(own)).otherwise(0))
    return opened(counted, tuple(keys), F.concat(alone("false", "f", "g"), alone("missed", "g", "f")), "kind")


def mean_lengths(spans: DataFrame) -> DataFrame:
    """``name, n, mean_length``."""
    return spans.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end") - F.col("start") + 1).alias("mean_length"))


def names_by_length(spans: DataFrame) -> DataFrame:
    """``name, n, mean_length``, the shortest kind first."""
    return mean_lengths(spans).orderBy("mean_length", "name")


def merged(spans: DataFrame, more: DataFrame) -> DataFrame:
    return spans.unionByName(more, allowMissingColumns=True)


def levels(spans: DataFrame) -> DataFrame:
    """Adds ``level``: rows for drawing, shorter spans lowest, each on the lowest row free over its tokens."""

    def place(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[list[tuple[int, int]]] = []
        out = {}
        by_length = group.assign(width=group.end - group.start).sort_values(["width", "start", "span_id"])
        for r in by_length.itertuples():
            k = next((k for k, row in enumerate(taken) if all(r.end < a or r.start > b for a, b in row)), len(taken))
            if k == len(taken):
                taken.append([])
            taken[k].append((r.start, r.end))
            out[r.span_id] = k
        return group.assign(level=group.span_id.map(out).astype("int32"))

    schema = StructType([*spans.schema.fields, StructField("level", IntegerType())])
    return spans.groupBy(*KEY).applyInPandas(place, schema)


def resolved_refs(stand_off: DataFrame, tokens: DataFrame) -> DataFrame:
    """Stand-off spans (``start_ref``, ``end_ref``) as token positions: two joins on (doc_id, ref)."""
    at = tokens.select("doc_id", "sid", "tid", "ref")
    start = at.select("doc_id", F.col("ref").alias("start_ref"), "sid", F.col("tid").alias("start"))
    end = at.select("doc_id", F.col("ref").alias("end_ref"), F.col("sid").alias("end_sid"), F.col("tid").alias("end"))
    both = stand_off.join(start, ["doc_id", "start_ref"]).join(end, ["doc_id", "end_ref"]).where("sid = end_sid")
    return both.drop("end_sid", "start_ref", "end_ref")


