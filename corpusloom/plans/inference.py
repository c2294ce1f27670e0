"""Grammars inferred from example sequences.

Examples are rows with an array of attribute values, ``keys``. Counting prefixes, telling states apart and comparing them are grouped aggregates and
equi-joins; their minimal automaton is the only thing that reaches the driver, since a grammar is a program: its edges are counted first, and more than
``most`` of them are an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import opened
from ..sources.shared import written
from .grammar import Grammar, GrammarError, Graph, Node, match, spans_from

#: Edges that a grammar may have.
MOST_EDGES = 20_000
#: The most pairs of alike nodes that come to the driver.
MOST_PAIRS = 2_000_000
#: The neighbour that stands for the end of an example.
END = "\0"
#: Nodes in a block, of which pairs are made, and characters of their names.
BLOCK, BLOCK_CHARS = 512, 1 << 20
#: Pairs that a task makes, as long as there are not more tasks than this.
TASK_PAIRS, MOST_TASKS = 20_000_000, 20_000

Edge = tuple[int, str, int]


def sequences(examples: DataFrame) -> DataFrame:
    """``keys, n``: the distinct sequences and how often each comes; null and empty ones, and those with a null key, are none."""
    whole = F.col("keys").isNotNull() & (F.size("keys") > 0) & ~F.exists("keys", lambda k: k.isNull())
    return examples.where(whole).groupBy("keys").agg(F.count("*").alias("n"))


def _number(keys: Column) -> Column:
    """A sequence's number: two 64-bit hashes."""
    return F.struct(F.xxhash64(keys).alias("a"), F.xxhash64(F.lit(1), keys).alias("b"))


def _spread(examples: DataFrame) -> DataFrame:
    """The distinct ``sequences`` with their number as ``seq``, written once, since prefixes are counted by numbers and read off the sequences afterwards."""
    rows = sequences(examples).withColumn("seq", _number(F.col("keys")))
    return written(rows)


def _prefixes(distinct: DataFrame, rests: bool = False) -> DataFrame:
    """``seq, n, size, depth, node`` and with ``rests`` ``rest, parent, key``: every prefix of each sequence, the empty one included, as numbers.

    No row holds a prefix itself: those of long sequences add up to the cube of their length.
    """
    part = lambda first, length: _number(F.slice("keys", first, length))
    d, n = F.col("depth"), F.col("size")
    more = [part(d + 1, n - d).alias("rest"), part(F.lit(1), F.greatest(d - 1, F.lit(0))).alias("parent"), F.get("keys", d - 1).alias("key")] if rests else []
    # A few long sequences hold most of the work: they go to many tasks, however small the table.
    spread = distinct.repartition(4 * distinct.sparkSession.sparkContext.defaultParallelism, "seq").withColumn("size", F.size("keys"))
    return spread.select("*", F.explode(F.sequence(F.lit(0), "size")).alias("depth")).select("seq", "n", "size", "depth", part(F.lit(1), d).alias("node"), *more)


def _read_off(nodes: DataFrame, distinct: DataFrame) -> DataFrame:
    """``nodes`` (``seq, depth``) with their ``prefix``, cut from a sequence that passes them."""
    return nodes.join(distinct.select("seq", "keys"), "seq").withColumn("prefix", F.slice("keys", F.lit(1), F.col("depth"))).drop("keys", "seq")


def prefix_tree(examples: DataFrame) -> DataFrame:
    """``prefix, depth, n, ends``: the tree's nodes, the examples that pass each, and those that end there."""
    distinct = _spread(examples)
    ends = F.sum(F.when(F.col("depth") == F.col("size"), F.col("n")).otherwise(0))
    counted = _prefixes(distinct).groupBy("node", "depth").agg(F.sum("n").alias("n"), ends.alias("ends"), F.min("seq").alias("seq"))
    return _read_off(counted, distinct).select("prefix", "depth", "n", "ends")


def _states(distinct: DataFrame) -> DataFrame:
    """``node, depth, seq, parent, key, state, ends`` of each prefix.

    Sets of rests are compared by their number and two 64-bit hashes, so that no group is collected: the root's rests are all examples.
    """
    parts = [F.bit_xor("rest.a"), F.bit_xor("rest.b"), F.count("*")]
    of = F.struct(*(p.alias(f"h{k}") for k, p in enumerate(parts))).alias("of")
    held = _prefixes(distinct, rests=True).groupBy("node", "depth").agg(of, F.max(F.col("depth") == F.col("size")).alias("ends"), F.min("seq").alias("seq"), F.min("parent").alias("parent"), F.min("key").alias("key"))
    return held.withColumn("state", F.xxhash64("of")).drop("of")


def states(examples: DataFrame) -> DataFrame:
    """``prefix, state, alike, ends``: prefixes that the same rests follow are one state of the minimal automaton; ``alike`` counts them."""
    distinct = _spread(examples)
    alike = F.count(F.lit(1)).over(Window.partitionBy("state"))
    known = _states(distinct).select("seq", "depth", "state", alike.alias("alike"), "ends")
    return _read_off(known, distinct).select("prefix", "state", "alike", "ends")


def automaton(examples: DataFrame) -> DataFrame:
    """``source, key, target, ends, first``: the minimal automaton's edges, whether the target accepts, and whether the source is where examples start."""
    known = written(_states(_spread(examples)).drop("seq"))
    after = known.where("depth > 0").select("parent", "key", F.col("state").alias("target"), "ends")
    before = known.select(F.col("node").alias("parent"), F.col("state").alias("source"), (F.col("depth") == 0).alias("first"))
    return after.join(before, "parent").select("source", "key", "target", "ends", "first").distinct()


def similar_nodes(nodes: DataFrame) -> DataFrame:
    """``a, b, similarity`` of nodes with one key that share a neighbour, from ``node, key, side, neighbour``.

    Twice the neighbours shared, over all of both, scaled to [-1, 1]; an end (``END`` after a node) counts only where both end. Nodes that share no
    neighbour have -1 and give no row.

    Nodes with equal rows (a kind, told by two 64-bit hashes) are alike to all others in the same way, so one node of each kind is compared. The pairs of nodes
    are made last, by blocks of some ``BLOCK`` nodes and ``BLOCK_CHARS`` characters of a kind: of two kinds the one with fewer nodes goes to the blocks of the other, where a
    task opens two blocks at a time. No pair is shuffled, and no side is broadcast, since names that begin alike look small while they are compressed.
    """
    rows = nodes.select("node", "key", "side", "neighbour").distinct()
    row = ("key", "side", "neighbour")
    kind = F.struct(F.bit_xor(F.xxhash64(*row)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("b"), F.count("*").alias("n"))
    kinds = written(rows.groupBy("node").agg(kind.alias("kind")))
    n_blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length(F.col("node").cast("string"))) / BLOCK_CHARS, F.lit(1))).cast("int")
    chosen = written(kinds.groupBy("kind").agg(F.min("node").alias("node"), F.count("*").alias("n"), n_blocks.alias("blocks")))
    compared_kinds = _similar(rows.join(chosen.select("kind", "node"), "node").drop("node"))
    known = compared_kinds.unionByName(chosen.select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(1.0).alias("similarity")))
    for side in "ab":
        known = known.join(chosen.select(F.col("kind").alias(side), F.struct("n", "kind", "blocks").alias(f"{side}_of")), side)
    fewer, more = F.least("a_of", "b_of"), F.greatest("a_of", "b_of")
    known = written(known.select(fewer.alias("fewer"), more.alias("more"), "similarity"))
    pairs = known.agg(F.sum(F.col("fewer.n").cast("double") * F.col("more.n"))).first()[0] or 0
    parallel = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    tasks = int(max(parallel, min(pairs // TASK_PAIRS, MOST_TASKS)))
    dealt = kinds.join(chosen.select("kind", "blocks"), "kind").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    blocks = written(dealt.groupBy("kind", "block").agg(F.collect_list("node").alias("nodes")))
    asking = known.select(F.col("fewer.kind").alias("kind"), F.col("more.kind").alias("to"), F.col("more.blocks").alias("blocks"), "similarity")
    moved = asking.repartition(parallel, "kind", "to").join(blocks.hint("merge"), "kind")
    moved = moved.select("kind", "to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "similarity", F.col("nodes").alias("own"))
    met = moved.repartition(tasks, "to", "block").join(blocks.withColumnRenamed("kind", "to").repartition(tasks, "to", "block").hint("merge"), ["to", "block"])
    opened_own = met.select((F.col("kind") == F.col("to")).alias("one"), "similarity", "nodes", F.explode("own").alias("x"))
    both = opened_own.select("one", "similarity", "x", F.explode("nodes").alias("y")).where(~F.col("one") | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _similar(rows: DataFrame) -> DataFrame:
    """``a, b, similarity`` of ``kind, key, side, neighbour``, each pair compared by itself; ``a < b``."""
    sizes = rows.groupBy("kind").agg(F.count_if(F.col("neighbour") != END).alias("size"))
    left = rows.select(F.col("kind").alias("a"), "key", "side", "neighbour")
    right = rows.select(F.col("kind").alias("b"), "key", "side", "neighbour")
    shared = left.join(right, ["key", "side", "neighbour"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("neighbour") == END).alias("both_end"))
    sized = shared.join(sizes.select(F.col("kind").alias("a"), F.col("size").alias("a_size")), "a").join(sizes.select(F.col("kind").alias("b"), F.col("size").alias("b_size")), "b")
    all_of = F.col("a_size") + F.col("b_size") + 2 * F.col("both_end")
    return sized.select("a", "b", (4 * F.col("shared") / all_of - 1).alias("similarity"))


def tree_neighbours(examples: DataFrame) -> DataFrame:
    """``node, key, side, neighbour`` of the prefix tree's nodes, named by their prefixes' keys with blanks between."""
    tree = written(prefix_tree(examples).where("depth > 0"))
    name = F.array_join("prefix", " ")
    own = tree.select(name.alias("node"), F.element_at("prefix", -1).alias("key"), "prefix", "ends", "depth")
    before = own.select("node", "key", F.lit("before").alias("side"), F.when(F.col("depth") > 1, F.get("prefix", F.col("depth") - 2)).otherwise(F.lit("")).alias("neighbour"))
    ended = own.where("ends > 0").select("node", "key", F.lit("after").alias("side"), F.lit(END).alias("neighbour"))
    after = own.where("depth > 1").select(F.array_join(F.slice("prefix", F.lit(1), F.col("depth") - 1), " ").alias("node"), F.get("prefix", F.col("depth") - 2).alias("key"), F.lit("after").alias("side"), F.col("key").alias("neighbour"))
    return before.unionByName(ended).unionByName(after)


def accepts(rows: DataFrame, edges: Iterable[Edge], starts: Iterable[int], finals: Iterable[int]) -> DataFrame:
    """The ``rows`` whose ``keys`` some path of the automaton spells, by a fold over the keys inside the plan."""
    steps: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for source, key, target in edges:
        steps[key].append((source, target))
    pairs = lambda found: F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in found))
    longs = lambda found: F.array(*map(F.lit, found)).cast("array<bigint>")
    if not steps:
        return rows.where(F.lit(False))
    table = F.create_map(*(c for k, found in steps.items() for c in (F.lit(k), pairs(found))))

    def step(at: Column, key: Column) -> Column:
        moves = F.filter(F.try_element_at(table, key), lambda e: F.array_contains(at, e["a"]))
        return F.coalesce(F.array_distinct(F.transform(moves, lambda e: e["b"])), longs([]))

    return rows.where(F.arrays_overlap(F.aggregate("keys", longs(starts), step), longs(finals)))


def _value(key: str) -> str:
    """A key as a condition's value; signs that conditions use are written as a regular expression."""
    return key if re.fullmatch(r"[^\s=<>/@|+\-]+", key) else "/" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in key) + "/"


class Inferred:
    """A grammar being generalised: nodes are (key, state) pairs by number, joined by ``union``."""

    def __init__(self, rows: list[tuple]) -> None:
        self.numbers: dict[tuple[str, int], int] = {}
        for _, key, target, _, _ in sorted(rows):
            self.numbers.setdefault((key, target), len(self.numbers) + 1)
        self.keys = {n: key for (key, _), n in self.numbers.items()}
        entering = defaultdict(set)
        for (_, target), n in self.numbers.items():
            entering[target].add(n)
        self.starts = {self.numbers[key, target] for _, key, target, _, first in rows if first}
        self.finals = {self.numbers[key, target] for _, key, target, ends, _ in rows if ends}
        self.links = {(p, self.numbers[key, target]) for source, key, target, _, _ in rows for p in entering[source]}

    def merged(self, pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
        """Each node with the least one that ``pairs`` tie it to."""
        top = {n: n for n in self.keys}

        def root(n: int) -> int:
            while top[n] != n:
                top[n] = top[top[n]]
                n = top[n]
            return n

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            top[b] = a
        return {n: root(n) for n in top}

    def edges(self, top: dict[int, int]) -> set[Edge]:
        """The automaton over nodes, each entered by its own key; 0 is the start."""
        return {(top[a], self.keys[b], top[b]) for a, b in self.links} | {(0, self.keys[n], top[n]) for n in self.starts}

    def neighbours(self) -> list[tuple[int, str, str, str]]:
        rows = [(n, self.keys[n], "before", "") for n in self.starts] + [(n, self.keys[n], "after", END) for n in self.finals]
        return rows + [r for a, b in self.links for r in ((a, self.keys[a], "after", self.keys[b]), (b, self.keys[b], "before", self.keys[a]))]

    def kinds(self) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, int]]]:
        """The neighbours of the least node of each kind, and that node with each other one of its kind: nodes with equal neighbours are alike to all others in the same way."""
        held: dict[int, set[tuple]] = defaultdict(set)
        for n, *row in self.neighbours():
            held[n].add(tuple(row))
        least: dict[frozenset, int] = {}
        same = [(first, n) for n in sorted(held) if (first := least.setdefault(frozenset(held[n]), n)) != n]
        return [(n, *row) for own, n in least.items() for row in sorted(own)], same

    def grammar(self, top: dict[int, int], attribute: str) -> Grammar:
        """Longer paths first: a node's way to the end is its last child; a loop comes before all others, so that it is greedy."""
        children: dict[int, set[int]] = defaultdict(set)
        for a, _, b in self.edges(top):
            children[a].add(b)
        finals, end = {top[n] for n in self.finals}, len(self.keys) + 1
        nodes = {0: Node("<E>", sorted(children[0])), end: Node("<X>")}
        for n in set(top.values()):
            nodes[n] = Node(f"<+{attribute}={_value(self.keys[n])}>", sorted(children[n], key=lambda c: (c != n, c)) + ([end] if n in finals else []))
        return Grammar({"Main": Graph(nodes, 0, end)})


def infer(examples: DataFrame, attribute: str, negatives: DataFrame | None = None, similarity: float | None = 1.0, most: int = MOST_EDGES) -> Grammar:
    """A grammar over ``attribute`` that accepts all examples (``keys``).

    The examples' minimal automaton is generalised by joining nodes of one key at least as alike as ``similarity`` (None: not at all), level by level from
    the most alike; a level that would accept one of ``negatives`` (``keys``) is the first that is left out. Negatives that are examples too do not count.
    No examples, more than ``most`` edges, or more than ``MOST_PAIRS`` alike pairs are an error: that much reaches the driver.
    """
    rows = [tuple(r) for r in automaton(examples).limit(most + 1).collect()]
    if not rows or len(rows) > most:
        raise GrammarError("no examples" if not rows else f"the examples need more than {most} edges")
    found = Inferred(rows)
    taken: list[tuple[int, int]] = []
    if similarity is not None:
        spark = examples.sparkSession
        known, same = found.kinds()
        compared_kinds = _similar(spark.createDataFrame(known, "kind long, key string, side string, neighbour string"))
        alike = [tuple(r) for r in compared_kinds.where(F.col("similarity") >= similarity).limit(MOST_PAIRS + 1).collect()]
        if len(alike) > MOST_PAIRS:
            raise GrammarError(f"more than {MOST_PAIRS} pairs of nodes are alike; ask for more similarity")
        alike += [(a, b, 1.0) for a, b in same if similarity <= 1]
        wrong = None if negatives is None else conflict_free(negatives, examples)
        for level in sorted({s for _, _, s in alike}, reverse=True):
            trial = taken + [(a, b) for a, b, s in alike if s == level]
            top = found.merged(trial)
            if wrong is not None and not accepts(wrong, sorted(found.edges(top)), [0], sorted({top[n] for n in found.finals})).isEmpty():
                break
            taken = trial
    return found.grammar(found.merged(taken), attribute)


def conflict_free(negatives: DataFrame, examples: DataFrame) -> DataFrame:
    """The distinct negatives that are no examples."""
    return negatives.select("keys").distinct().join(examples.select("keys"), "keys", "left_anti")


def example_keys(sentences: DataFrame, spans: DataFrame, attribute: str, features: str = "features") -> DataFrame:
    """``doc_id, sid, start, end, keys``: the attribute's values under each span."""
    return _under(sentences.select("doc_id", "sid", F.transform(features, lambda t: F.try_element_at(t, F.lit(attribute))).alias("all_keys")), spans)


def _under(at: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, sid, start, end, keys``: the values of ``all_keys`` under each span."""
    both = at.join(spans.select("doc_id", "sid", "start", "end"), ["doc_id", "sid"])
    return both.select("doc_id", "sid", "start", "end", F.slice("all_keys", F.col("start") + 1, F.col("end") - F.col("start") + 1).alias("keys"))


def compared(found: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens found but not in ``gold``, tokens of ``gold`` not found, and the found spans that are wrong.

    A found span is wrong if it holds a token outside of ``gold`` and either meets no span of ``gold`` or reaches beyond the first that it meets.
    """
    place = ["doc_id", "sid", "start", "end"]
    tokens = lambda s: s.select("doc_id", "sid", F.explode(F.sequence("start", "end")).alias("tid")).distinct()

    def beyond_others(own: DataFrame, others: DataFrame) -> DataFrame:
        # A span that both have differs in no token: only the others are opened, and of the other side the spans of their sentences.
        alone = own.select(place).distinct().join(others.select(place), place, "left_anti")
        near = others.join(alone.select("doc_id", "sid").distinct(), ["doc_id", "sid"], "left_semi")
        return tokens(alone).join(tokens(near), ["doc_id", "sid", "tid"], "left_anti")

    extra, missed = beyond_others(found, gold), beyond_others(gold, found)
    opened = found.select(*place, F.explode(F.sequence("start", "end")).alias("tid"))
    outside = opened.join(extra, ["doc_id", "sid", "tid"], "left_semi").select(*place).distinct()
    over = gold.select("doc_id", "sid", F.struct("start", "end").alias("gold"), F.explode(F.sequence("start", "end")).alias("tid"))
    met = opened.join(over, ["doc_id", "sid", "tid"], "left").groupBy(*place).agg(F.min("gold").alias("gold"))
    beyond = F.col("gold").isNull() | (F.col("start") < F.col("gold.start")) | (F.col("end") > F.col("gold.end"))
    return extra, missed, met.where(beyond).select(*place).join(outside, place, "left_semi")


def bootstrap(sentences: DataFrame, gold: DataFrame, attribute: str, similarity: float = 0.0, rounds: int = 10) -> tuple[Grammar, DataFrame]:
    """A grammar for the ``gold`` spans, and its matches: what it matches wrongly becomes negative examples until the errors stay the same.

    ``sentences`` have feature maps. Their values of the attribute, the spans, their distinct sequences, and each round's matches and wrong sequences are written to the shared
    folder, so that the sentences are computed once, and no round computes an earlier one again.
    """
    values = F.transform("features", lambda t: F.try_element_at(t, F.lit(attribute)))
    kept = written(sentences.select("doc_id", "sid", values.alias("values")), "zstd")
    gold = written(gold.select("doc_id", "sid", "start", "end"))
    under = lambda spans: _under(kept.withColumnRenamed("values", "all_keys"), spans).select("keys").distinct()
    examples = written(under(gold))
    negatives, before = None, None
    for _ in range(rounds):
        grammar = infer(examples, attribute, negatives, similarity)
        found = written(spans_from(match(kept, grammar, "values", of=lambda w: {attribute: w}), "FOUND").drop("span_id", "name"))
        extra, missed, wrong = compared(found, gold)
        counts = (extra.count(), missed.count())
        if not counts[0] or counts == before:
            break
        before = counts
        keys = written(under(wrong))
        negatives = keys if negatives is None else negatives.union(keys).distinct()
    return grammar, found
