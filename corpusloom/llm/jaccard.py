"""N-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, broadcast_if_small, distinct, marked, mix, row_key, shingle_hashes, stage, unstage, word_hashes

#: Minimum hashes that propose groups.
HASHES = 6
#: A token that so many of the sets have that share a minimum hash with another stands at the end of the token order.
COMMON = 8
#: Members from which on a group's rows are not shuffled to one place.
HOT = 1000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct hashed n-word shingles, sorted."""
    return distinct(shingle_hashes(word_hashes(text, lower=True), n))


def set_number(tokens: np.ndarray) -> int:
    """One 64-bit number for a set of tokens."""
    total = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def least_overlap(a: int, percent: int) -> int:
    """The least overlap that a set of this size has with any linked one: the ceiling of percent * a."""
    return -(-percent * a // 100)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap of two sets of distinct values; an upper bound of it where some values were cut short."""
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * overlap >= percent * union, in whole numbers."""
    return (100 + percent) * overlap(a, b) >= percent * (len(a) + len(b))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for t in batch.column(column):
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, row, node, size, keys``: each row's set number (null without words), its size and minimum hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for raw in _texts(batch, 2):
                tokens = shingle_set(raw, n)
                sizes.append(len(tokens))
                nodes.append(set_number(tokens) if len(tokens) else None)
                keys.append([int(mix(tokens ^ s).min().view(np.int64)) for s in _SEEDS] if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select("doc_id", row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, size long, keys array<long>")


def ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, row``: the distinct ends of pairs (a, b), each with the row that stands for it."""
    found = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return stage(found.join(nodes.select("node", "row"), "node"))


def set_table(docs: DataFrame, nodes: DataFrame, n: int, short: bool) -> DataFrame:
    """``node, tokens`` of the sets of ``nodes`` (node, row; staged, and deleted here), packed; ``short``: the tokens' lower 32 bits.

    Only the rows that stand for a node are read in Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, n) for raw in _texts(batch, 1)]
            packed = pa.array([(_low(t) if short else t).tobytes() for t in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["node", "tokens"])

    few = broadcast_if_small(nodes.withColumnRenamed("row", "of_row"), nodes.count(), 1_000_000)
    rows = docs.select(row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    out = stage(rows.join(few, F.col("row") == F.col("of_row")).select("node", "text").mapInArrow(run, "node long, tokens binary"))
    unstage(nodes)
    return out


def compared(pairs: DataFrame, sets: DataFrame, kind: type, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose packed sets link, or may."""
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "tokens": "a_tokens"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "tokens": "b_tokens"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda k: (np.frombuffer(x.as_buffer(), kind) for x in batch.column(k))  # noqa: B023, E731
            keep = pa.array([may_link(x, y, percent) for x, y in zip(of(2), of(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    # Rows repeated in every column bring their set, and so a pair, several times.
    return stage(both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long").distinct())


def linked_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, short: DataFrame | None = None) -> DataFrame:
    """The pairs ``a, b`` whose sets link: those that their ``short`` sets do not rule out, by whole sets."""
    left = pairs if short is None else compared(pairs, short, np.uint32, percent)
    whole = set_table(docs, ends(left, nodes), n, False)
    out = compared(left, whole, np.uint64, percent)
    unstage(whole, left)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, group``: every node of ``edges`` (a, b) with the least number it can reach.

    Each round takes the least label among neighbours, then the label of that label, so paths
    halve; rounds end when no label changes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("group")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("m"))
        hooked = stage(labels.join(near, labels["node"] == near["a"]).select("node", F.least("group", "m").alias("group"), F.col("group").alias("old")))
        up = hooked.select(F.col("node").alias("up"), F.col("group").alias("top"))
        before, moved = labels, stage(hooked.join(up, hooked["group"] == up["up"]).select("node", F.least("group", "top").alias("group"), "old"))
        labels = moved.select("node", "group")
        labels._stage_path = moved._stage_path
        unstage(before, hooked)
        if not moved.agg(F.count_if(F.col("group") != F.col("old"))).first()[0]:
            unstage(both)
            return labels


def proposed(nodes: DataFrame, *first: str) -> DataFrame:
    """Pairs (a, b) of each node with the leader of each group of nodes that share a minimum hash.

    A group's leader has the least ``first`` columns, and the least of a hash that each minimum hash has of its own. It is one
    aggregate, and its pairs are as many as its members. Members of groups over HOT, which are few, meet their leader
    where they are, those of the others by a shuffle.
    """
    keyed = nodes.select("node", *first, F.posexplode("keys").alias("k", "key"))
    order = F.struct(*first, F.xxhash64("node", "k").alias("h"), "node")
    leaders = keyed.groupBy("k", "key").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("c"))
    led = stage(leaders.where("c > 1").select("k", "key", F.col("m.node").alias("leader"), (F.col("c") > HOT).alias("hot")))
    hot, cold = (led.where(w).drop("hot") for w in ("hot", "NOT hot"))
    large = broadcast_if_small(hot.withColumnRenamed("leader", "large"), hot.count())
    found = keyed.select("node", "k", "key").join(large, ["k", "key"], "left")
    small = found.where("large IS NULL").join(cold, ["k", "key"]).select("node", "leader")
    pairs = found.where("large IS NOT NULL").select("node", F.col("large").alias("leader")).unionByName(small).where("node <> leader")
    out = stage(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    unstage(led)
    return out


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one group yet."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("group").alias(f"{end}_group")), end, "left")
    return stage(pairs.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b"))


def rare_tokens(short: DataFrame, flags) -> DataFrame:
    """``node, rare``: how many tokens of each set are not marked as common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [int((~marked(flags.value, np.frombuffer(x.as_buffer(), np.int32).astype(np.int64).view(np.uint64))).sum()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["node", "rare"])

    return short.mapInArrow(run, "node long, rare long").groupBy("node").agg(F.min("rare").alias("rare"))


def _low(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint32).view(np.int32)


def common_tokens(short: DataFrame) -> DataFrame:
    """``token``: lower bits of the tokens that COMMON or more of the sets ``short`` have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)])) if len(batch) else np.empty(0, np.int32)
            edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values[edge]), pa.array(np.diff(np.append(edge, len(values))).astype(np.int32))], names=["token", "n"])

    counted = short.select("tokens").mapInArrow(count, "token int, n int").groupBy("token").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= COMMON).select(F.col("token").cast("long").alias("token"))


def prefixes(docs: DataFrame, flags, n: int, percent: int) -> DataFrame:
    """``node, size, index, tokens``: the lower 32 bits of each set's first tokens in one order of all tokens, common ones last.

    Two linked sets share a token of both prefixes, and the smaller one has it among its first ``index``.
    The order is any function of the token, so what the bitmap marks by chance does no harm; nor does it that
    two tokens may have the same lower bits, since candidates are compared by whole sets.
    """

    def bounds(size: int) -> tuple[int, int]:
        """Prefix lengths of a set as the larger and as the smaller one (or of equal size) of a pair."""
        return size - least_overlap(size, percent) + 1, size - -(-2 * percent * size // (100 + percent)) + 1

    texts = docs.select(F.col("text").cast("string").alias("text"))
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("index", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, tuple] = {}
            for raw in _texts(batch, 0):
                tokens = shingle_set(raw, n)
                if len(tokens) and (node := set_number(tokens)) not in rows:
                    low = _low(tokens)
                    late = marked(flags.value, low.astype(np.int64).view(np.uint64))
                    longest, index = bounds(len(tokens))
                    rows[node] = (node, len(tokens), index, np.concatenate([low[~late], low[late]])[:longest])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows.values(), strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(cut, "node long, size long, index long, tokens array<int>")


def open_groups(docs: DataFrame, groups: DataFrame, flags, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different groups that may still link.

    The token-group matrix holds, for each group, the union of its members' index prefixes. A set's
    overlap with any member is at most its tokens outside the prefix plus its prefix tokens in
    the group's union, so a group without one of them, or without members of a size
    that can link, stays shut. Of the open ones, members that hold the shared token and may link by size are compared.
    Tokens of one group only, nearly all, end at an aggregate with a row for each task and token.
    """
    known = groups.select(F.col("node").alias("known"), "group")
    listed = stage(prefixes(docs, flags, n, percent))
    placed = listed.join(broadcast_if_small(known, known.count(), 1_000_000), F.col("node") == F.col("known"), "left").withColumn("group", F.coalesce("group", "node"))
    entries = placed.select("node", "size", "group", F.posexplode("tokens").alias("at", "token"), "index").withColumn("inner", F.col("at") < F.col("index"))
    across = entries.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
    across = stage(across)
    held = stage(entries.join(broadcast_if_small(across, across.count(), 1_000_000), "token", "left_semi").drop("index").distinct())
    left = F.max(F.col("size") - F.col("at")).alias("g_after")
    union = held.where("inner").groupBy("token", "group").agg(F.min("size").alias("least"), F.max("size").alias("most"), left)
    asked = held.select("token", F.col("node").alias("q"), F.col("size").alias("q_size"), F.col("group").alias("q_group"), F.col("at").alias("q_at"))
    fits = (F.col("least") * percent <= F.col("q_size") * 100) & (F.col("q_size") * percent <= F.col("most") * 100)
    # The first token that two sets share bounds their overlap by what stands after it in either.
    enough = lambda mine, other, size: (100 + percent) * F.least(mine, other) >= percent * (F.col("q_size") + size)
    open_to = fits & enough(F.col("q_size") - F.col("q_at"), F.col("g_after"), F.col("least"))
    opened = asked.join(union, "token").where((F.col("q_group") != F.col("group")) & open_to).select("token", "q", "q_size", "q_at", "group")
    near = enough(F.col("q_size") - F.col("q_at"), F.col("size") - F.col("at"), F.col("size")) & (F.col("size") <= F.col("q_size"))
    pairs = opened.join(held.where("inner").select("token", "group", "node", "size", "at"), ["token", "group"]).where(near)
    out = stage(pairs.select(F.least("q", "node").alias("a"), F.greatest("q", "node").alias("b")).distinct())
    unstage(listed, across, held)
    return out


def grouped_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, row, size, group, component_id`` of each row; see ``jaccard_groups``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage(sketches(rows, n))
    nodes = stage(sketch.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("keys").alias("keys")))
    pairs = proposed(nodes)
    short = set_table(rows, ends(pairs, nodes), n, True)
    edges = linked_pairs(pairs, nodes, rows, n, percent, short)
    unstage(pairs)
    groups = components(edges)
    # Of many edited copies of one text, those with the fewest tokens of their own link with the most others.
    flags = docs.sparkSession.sparkContext.broadcast(bitmap_of(common_tokens(short)))
    central = proposed(nodes.join(rare_tokens(short, flags), "node"), "rare")
    asked = apart(central, groups)
    edges = edges.union(linked_pairs(asked, nodes, rows, n, percent, short))
    unstage(central, asked, short, groups)
    groups = components(edges)
    candidates = open_groups(rows, groups, flags, n, percent)
    if not candidates.isEmpty():
        edges = edges.union(linked_pairs(candidates, nodes, rows, n, percent))
        unstage(groups)
        groups = components(edges)
    numbered = nodes.join(groups, "node", "left").select("node", "least", F.coalesce("group", "node").alias("group"))
    least = numbered.groupBy("group").agg(F.min("least").alias("component_id"))
    of = numbered.join(least, "group").select("node", "group", "component_id")
    return sketch.drop("keys").join(of, "node", "left").drop("node")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents joined by Jaccard similarity of their shingle sets.

    Two documents link when 100 * intersection >= ``percent`` * union; a component is all that links reach, its
    number the least doc_id in it.

    1. Equal sets are one node, by an aggregate. 2. Nodes that share a minimum hash form a group; each is compared with
    a leader drawn by lot and with its most central node, and what links makes components, the groups of the matrix.
    3. Every set asks the token-group matrix for groups other than its own; only those that its
    overlap bound lets qualify are opened and their members compared whole. So every link between different
    components is found, and links inside one, which cannot change it, are not all looked up.

    Words are compared by ASCII lower case; shingles are compared by 64-bit hashes. Null texts and texts without words
    have size 0 and link with nothing; their component is their own doc_id. Rows count one by one; a null
    doc_id takes the least number its links reach, or null. No rows give no rows.
    """
    found = grouped_rows(docs, n, percent)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null last), of the least hash of its row in a tie.

    Texts without words all stay, and all columns do.
    """
    found = grouped_rows(docs, n, percent).where("size > 0")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("jc_chosen"))
    tagged = docs.withColumn("jc_row", row_key(docs)).withColumn("jc_words", F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    worded = tagged.where("jc_words").join(first, F.col("jc_row") == F.col("jc_chosen"), "left_semi").dropDuplicates(["jc_row"])
    return tagged.where("NOT jc_words").unionByName(worded).drop("jc_row", "jc_words")
