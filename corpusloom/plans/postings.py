"""Posting lists: which sentences hold a value, so that a grammar reads only those in which it can match.

An index keeps the sentences in ``PARTS`` folders by document, and beside them one row for each distinct attribute and value of a sentence, in folders by
attribute and by a hash of the value. A grammar's needs are a formula over such values; the sentences that meet it are found in the posting lists
alone, and of the sentences only the folders that hold some of them are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import opened
from ..operators.predicates import Clause, parse_clauses, pattern_of, with_macros
from .grammar import Grammar, check, kind_of, match

#: Folders of sentences, and of the values of an attribute.
PARTS, BUCKETS = 64, 16


@dataclass(frozen=True)
class Has:
    """A sentence holds a token whose attribute has this value, or a value that the pattern matches."""

    attribute: str
    value: str


@dataclass(frozen=True)
class Both:
    parts: frozenset


@dataclass(frozen=True)
class Either:
    parts: frozenset


#: What every sentence meets; None stands for what no sentence meets.
ANY = Both(frozenset())
Need = Has | Both | Either


def _both(parts: list[Need]) -> Need:
    flat = frozenset(p for x in parts for p in (x.parts if isinstance(x, Both) else [x]))
    return next(iter(flat)) if len(flat) == 1 else Both(flat)


def _either(parts: list[Need]) -> Need:
    flat = frozenset(p for x in parts for p in (x.parts if isinstance(x, Either) else [x]))
    return ANY if ANY in flat else next(iter(flat)) if len(flat) == 1 else Either(flat)


def _of_clause(clause: Clause) -> Need:
    """Only positive terms of named attributes say that some value is there; negative ones and patterns of names say nothing."""
    if clause.span:
        return ANY
    return _both([Has(t.attribute, t.value) for t in clause.terms if t.positive and pattern_of(t.attribute) is None])


def needs(grammar: Grammar) -> Need:
    """What a sentence must hold for the main graph to match: along each path all of its conditions, of the paths any one.

    A node met again on its own path, and a graph that calls itself, add nothing; so do look-arounds and cross references, which could only add more.
    So the formula may ask for too little, never for too much.
    """

    def of_graph(name: str, calls: tuple[str, ...]) -> Need:
        if name in calls:
            return ANY
        graph, held = grammar.graphs[name], {}

        def onward(number: int, path: frozenset[int]) -> Need:
            node = graph.nodes[number]
            kind, code = kind_of(grammar, node)
            own = ANY if number == graph.end else of_graph(code, (*calls, name)) if kind == "call" else _either([_of_clause(c) for c in parse_clauses(code)]) if kind == "token" and "$" not in code else ANY
            if number == graph.end or not node.children:
                return own
            if number not in held:
                # A way back to a node of the path says no more than that path does; one to the node itself is a loop that any path may leave out.
                further = [ANY if c in path else onward(c, path | {number}) for c in node.children if c != number]
                held[number] = _both([own, _either(further)]) if further else own
            return held[number]

        return onward(graph.start, frozenset())

    check(grammar)
    return of_graph(grammar.main, ())


def terms_of(need: Need) -> list[Has]:
    if isinstance(need, Has):
        return [need]
    return sorted({t for p in need.parts for t in terms_of(p)}, key=lambda t: (t.attribute, t.value))


def _entries(features: pa.Array) -> pa.Array:
    """The distinct attributes and values of each sentence's feature maps, those of a batch at once; null values and null maps say nothing."""
    n = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    maps = features.flatten()
    # A null map holds no entries.
    places = maps.offsets.to_numpy()
    held, items = np.diff(places), [x.slice(places[0], places[-1] - places[0]) for x in (maps.keys, maps.items)]
    row = np.repeat(np.repeat(np.arange(len(n)), n), held)
    keys, values = (x.dictionary_encode() for x in items)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    key, value = (pc.fill_null(x.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (keys, values))
    at = np.flatnonzero(known)
    first = at[np.unique(((row * max(1, len(keys.dictionary)) + key) * max(1, len(values.dictionary)) + value)[at], return_index=True)[1]]
    offsets = np.searchsorted(row[first], np.arange(len(n) + 1))
    found = pa.StructArray.from_arrays([x.take(pa.array(first)) for x in items], names=["key", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)


def write_index(sentences: DataFrame, path: str, features: str = "features") -> None:
    """Keep sentences (``doc_id, sid`` and a column of feature maps) and their posting lists under ``path``."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    sentences.withColumn("part", part).write.partitionBy("part").parquet(f"{path}/sentences")
    kept = sentences.sparkSession.read.parquet(f"{path}/sentences")
    entries = F.arrow_udf(_entries, "array<struct<key:string,value:string>>")(features)
    rows = opened(kept, ("doc_id", "sid", "part"), entries, "e").select(F.col("e.key").alias("attribute"), F.col("e.value").alias("value"), "doc_id", "sid", "part")
    known = rows.where("value IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int"))
    # Within a file values stand in order, so that a filter on one skips the others' row groups; a frequent value is spread over the writing tasks.
    known.sortWithinPartitions("attribute", "bucket", "value").write.partitionBy("attribute", "bucket").parquet(f"{path}/postings")
    counts = sentences.sparkSession.read.parquet(f"{path}/postings").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    counts.write.partitionBy("attribute").parquet(f"{path}/values")


def selective(spark: SparkSession, path: str, need: Need, factor: int = 8) -> Need:
    """A need without the parts that many sentences meet where a rarer part stands beside them: their lists are not worth reading."""
    terms = terms_of(need)
    if not terms:
        return need
    values = spark.read.parquet(f"{path}/values")
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | ((F.col("attribute") == t.attribute) & _holds(t))
    sums = values.where(wanted).agg(*(F.coalesce(F.sum(F.when((F.col("attribute") == t.attribute) & _holds(t), F.col("n"))), F.lit(0)).alias(f"t{k}") for k, t in enumerate(terms))).first()
    size = dict(zip(terms, sums, strict=True))

    def weighed(n: Need) -> tuple[float, Need]:
        if isinstance(n, Has):
            return size[n], n
        parts = [weighed(p) for p in n.parts]
        if isinstance(n, Either):
            return sum(w for w, _ in parts), _either([p for _, p in parts])
        least = min((w for w, _ in parts), default=float("inf"))
        return least, _both([p for w, p in parts if w <= factor * least])

    return weighed(need)[1]


def _wanted(postings: DataFrame, terms: list[Has]) -> Column:
    """The rows of the posting lists of some terms; an exact value names its folder."""
    bucket = {r["value"]: r["bucket"] for r in _buckets(postings.sparkSession, [t.value for t in terms if pattern_of(t.value) is None])}
    out = F.lit(False)
    for t in terms:
        own = F.col("attribute") == t.attribute
        out = out | (own & _holds(t) if pattern_of(t.value) is not None else own & (F.col("bucket") == bucket[t.value]) & _holds(t))
    return out


def _buckets(spark: SparkSession, values: list[str]) -> list:
    rows = spark.createDataFrame([(v,) for v in sorted(set(values))], "value string")
    return rows.select("value", F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()


def _holds(term: Has) -> Column:
    pattern = pattern_of(term.value)
    return F.col("value") == term.value if pattern is None else F.col("value").rlike(pattern)


def candidates(spark: SparkSession, path: str, need: Need) -> DataFrame | None:
    """``doc_id, sid, part`` of the sentences that meet a need; None where every one does."""
    terms = terms_of(need)
    if not terms:
        return None
    postings = spark.read.parquet(f"{path}/postings")
    flags = [F.max((F.col("attribute") == t.attribute) & _holds(t)).alias(f"t{k}") for k, t in enumerate(terms)]
    held = postings.where(_wanted(postings, terms)).groupBy("doc_id", "sid", "part").agg(*flags)

    def met(n: Need) -> Column:
        if isinstance(n, Has):
            return F.col(f"t{terms.index(n)}")
        out = F.lit(isinstance(n, Both))
        for p in n.parts:
            out = out & met(p) if isinstance(n, Both) else out | met(p)
        return out

    return held.where(met(need)).select("doc_id", "sid", "part")


def pruned(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """The index's sentences in which the grammar may match: of the others' folders nothing is read, of the rest the sentences that are no candidates are passed over."""
    sentences = spark.read.parquet(f"{path}/sentences")
    found = candidates(spark, path, selective(spark, path, needs(grammar)))
    if found is None:
        return sentences.drop("part")
    # At most PARTS numbers come to the driver.
    parts = sorted(r[0] for r in found.select("part").distinct().collect())
    return sentences.where(F.col("part").isin(parts)).join(found.drop("part"), ["doc_id", "sid"], "left_semi").drop("part")


def indexed_match(spark: SparkSession, path: str, grammar: Grammar, features: str = "features", **options: object) -> DataFrame:
    """The grammar's matches (``grammar.match``) in an index's sentences."""
    return match(pruned(spark, path, grammar), grammar, features, **options)
