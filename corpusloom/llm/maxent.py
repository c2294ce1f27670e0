"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, stage

#: The low bits of a word's key tell how it ends, the rest is its hash.
ENDING_BITS = 9
ENDINGS = 1 << ENDING_BITS
#: Classes of frequent words, and words in each; rarer words fall into as many classes by their endings.
HEAD_CLASSES, MEMBERS, TAIL_CLASSES = 16, 32, 16
CLASSES, HEAD = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * MEMBERS
#: Words whose counts travel with the tasks: the most frequent ones, in a table of fixed size.
COMMON = 1 << 16
#: Context symbols: frequent words, endings of all others, and the mark before a text.
BEFORE = HEAD + ENDINGS
SYMBOLS = BEFORE + 1
#: Hashed feature rows of either softmax.
ROWS = 1 << 13
#: Tokens of one update, of one chunk, and the parts of the corpus that follow each other.
BATCH, CHUNK, ROUNDS, RATE = 2048, 1 << 18, 3, 1.0
#: Weights travel as whole numbers of this fraction, weighed by this many tokens, so their sums do not depend on the order of tasks.
UNIT, WEIGHED = 1 << 20, 1 << 10
#: What a row has seen before any token.
SEEN = 1e-6
#: The key of a text's end.
END = np.uint64(0x5DEECE66D0000000)

_rng = np.random.default_rng(11)
_ENDING = _rng.integers(0, ENDINGS, 1 << 16).astype(np.uint64)
#: Rows of the features: the word before, the words two and three before (skipping those between), and for either softmax its own.
_SINGLE = _rng.integers(0, ROWS, (3, SYMBOLS)).astype(np.int64)
_INNER = _rng.integers(0, ROWS, (2, SYMBOLS, HEAD_CLASSES)).astype(np.int64)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Whether a row is not learned from; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def keys_of(raw: bytes) -> np.ndarray:
    """A text's tokens as 64-bit keys, its end last: 55 bits of the lower-cased word's hash and 9 bits of its last two bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    hashes, start, end = hashed_words(data, lower=True)
    out = np.empty(len(hashes) + 1, dtype=np.uint64)
    out[-1] = END
    if len(hashes):
        last = _LOWER[data[end - 1]]
        before = np.where(end - start > 1, _LOWER[data[np.maximum(end - 2, 0)]], np.uint32(0))
        out[:-1] = hashes >> np.uint64(ENDING_BITS) << np.uint64(ENDING_BITS) | _ENDING[last << np.uint32(8) | before]
    return out


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x.as_py() or b"" for x in batch.column(column).cast(pa.binary())]


# --- counts ----------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """``key, n``: how often each token stands in the texts (one column); counted in each task before the shuffle."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for raw in _texts(batch, 0):
                held.append(keys_of(raw))
                size += len(held[-1])
                if size >= 16 * CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(local, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Lookup:
    """Places of keys in a list of at most ``COMMON``: by their leading bits, the few that share a place by a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.bits = np.uint64(64 - max(8, min(20, (16 * len(keys)).bit_length())))
        self.first = np.full(1 << (64 - int(self.bits)), len(keys), dtype=np.int32)
        slot = (keys >> self.bits).astype(np.int64)
        self.first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.first[slot] != np.arange(len(keys)))
        self.rest = rest[np.argsort(keys[rest])]
        self.more = np.zeros(len(self.first), dtype=bool)
        self.more[slot[rest]] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = (keys >> self.bits).astype(np.int64)
        at = self.first[slot]
        at = np.where(self.keys[at] == keys, at, -1)
        at[at == len(self.keys) - 1] = -1
        if len(self.rest) and len(open_ := np.flatnonzero((at < 0) & self.more[slot])):
            sorted_keys, asked = self.keys[self.rest], keys[open_]
            k = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
            at[open_] = np.where(sorted_keys[k] == asked, self.rest[k], -1)
        return at


@dataclass
class Counts:
    """What the tasks know of the corpus: its size, the most frequent words, and each tail class's mass. Of fixed size."""

    n_tokens: int
    n_words: int
    keys: np.ndarray
    n: np.ndarray
    tail: np.ndarray

    def __post_init__(self):
        self.place, self.head = Lookup(self.keys), Lookup(self.keys[:HEAD])
        self.log = np.log10(self.n.astype(np.float64) + 1)

    @property
    def head_n(self) -> np.ndarray:
        out = np.zeros(HEAD)
        out[: min(HEAD, len(self.n))] = self.n[:HEAD]
        return out.reshape(HEAD_CLASSES, MEMBERS)


def counted(counts: DataFrame) -> Counts:
    """The fixed-size part of a staged table of counts: two totals, ``COMMON`` rows, and a number for each tail class."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, times = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((keys.view(np.int64), -times))
    keys, times = keys[order], times[order]
    tail = np.zeros(TAIL_CLASSES)
    for k, mass in counts.groupBy(F.col("key").bitwiseAND(F.lit(TAIL_CLASSES - 1)).alias("k")).agg(F.sum(F.col("n") + 1)).collect():
        tail[k] = mass
    # The head's words are in classes of their own; one unknown word more in each tail class.
    np.subtract.at(tail, (keys[:HEAD] & np.uint64(TAIL_CLASSES - 1)).astype(np.int64), times[:HEAD] + 1)
    return Counts(int(n), int(v), keys, times, tail + 1)


# --- the model -------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of the hashed features: ``outer`` gives a token's class, ``inner`` the word within a class of frequent words."""

    outer: np.ndarray
    inner: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    outer_seen: np.ndarray
    inner_seen: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.outer, self.inner, self.class_bias, self.word_bias, self.outer_seen, self.inner_seen]

    def copy(self) -> Model:
        return Model(*(p.copy() for p in self.parts()))

    def flat(self) -> np.ndarray:
        """All weights as one vector; what rows have seen as logarithms."""
        return np.concatenate([np.log2(p.astype(np.float64) + SEEN).ravel() if p.ndim == 1 and len(p) == ROWS else p.astype(np.float64).ravel() for p in self.parts()])

    def moved(self, change: np.ndarray) -> Model:
        """The model after a change of that vector."""
        flat, at, out = self.flat() + change, 0, []
        for p in self.parts():
            part = flat[at : at + p.size].reshape(p.shape)
            out.append((np.exp2(part) - SEEN if p.ndim == 1 and len(p) == ROWS else part).astype(np.float32))
            at += p.size
        return Model(*out)


def untrained(counts: Counts) -> Model:
    """Biases that give each word its share of the corpus; classes and places without words stay closed."""
    closed = np.float32(-1e4)
    head = counts.head_n
    mass = np.concatenate([head.sum(axis=1), counts.tail])
    with np.errstate(divide="ignore", invalid="ignore"):
        bias = np.where(mass > 0, np.log(mass / mass.sum()), closed)
        word = np.where(head > 0, np.log(head / head.sum(axis=1, keepdims=True)), closed)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    return Model(zeros(ROWS, CLASSES), zeros(ROWS, MEMBERS), bias.astype(np.float32), word.astype(np.float32), zeros(ROWS), zeros(ROWS))


@dataclass
class Events:
    """The tokens of some texts: feature rows of the class softmax, class, frequent tokens, their feature rows, and their places in the class."""

    rows: np.ndarray
    cls: np.ndarray
    at: np.ndarray
    inner_rows: np.ndarray
    member: np.ndarray


def events(keys: np.ndarray, sizes: np.ndarray, counts: Counts) -> Events:
    """Sparse features of concatenated texts' tokens: three words back at most, never across a text's beginning."""
    head = counts.head(keys)
    symbol = np.where(head >= 0, head, HEAD + (keys & np.uint64(ENDINGS - 1)).astype(np.int32)).astype(np.int64)
    # Three marks before each text.
    place = np.arange(len(keys)) + 3 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(keys) + 3 * len(sizes), BEFORE, dtype=np.int64)
    padded[place] = symbol
    one, two, three = padded[place - 1], padded[place - 2], padded[place - 3]
    pair = ((two * SYMBOLS + one) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 13)
    tail = (keys & np.uint64(TAIL_CLASSES - 1)).astype(np.int64)
    cls = np.where(head >= 0, head // MEMBERS, HEAD_CLASSES + tail)
    at = np.flatnonzero(head >= 0)
    inner = np.stack([_INNER[0, one[at], cls[at]], _INNER[1, two[at], cls[at]]])
    return Events(np.stack([_SINGLE[0, one], pair, _SINGLE[1, two], _SINGLE[2, three]]), cls, at, inner, head[at].astype(np.int64) % MEMBERS)


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities, a row a token."""
    z, held = np.take(weights, rows[0], axis=0, mode="clip"), np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=held, mode="clip")
        z += held
    z += bias
    # The largest of each row is only taken off where the exponentials need it.
    for shifted in (False, True):
        if shifted or z.max() > 80:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=held)
        sums = held @ np.ones(held.shape[1], np.float32)
        if not len(sums) or sums.min() > 1e-30:
            break
    z -= np.log(sums)[:, None]
    return z


def _descend(weights: np.ndarray, seen: np.ndarray, gradient: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """One step against the gradient of each token's rows. A row's step shrinks with what it has seen: no batch moves a row by more than ``rate``."""
    flat, width = weights.reshape(-1), weights.shape[1]
    power, columns = np.einsum("ij,ij->i", gradient, gradient), np.arange(width)
    step, cells = np.empty_like(gradient), np.empty(gradient.shape, np.int64)
    for r in rows:
        seen += np.bincount(r, minlength=len(seen)) * np.bincount(r, weights=power, minlength=len(seen))
        np.multiply(gradient, (-rate / np.sqrt(seen[r] + SEEN)).astype(np.float32)[:, None], out=step)
        np.add((r * width)[:, None], columns, out=cells)
        np.add.at(flat, cells.reshape(-1), step.reshape(-1))


def update(model: Model, e: Events, low: int, high: int, rate: float) -> None:
    """One gradient step on the tokens ``low`` to ``high``."""
    rows, cls = e.rows[:, low:high], e.cls[low:high]
    p = np.exp(log_softmax(model.outer, model.class_bias, rows))
    p[np.arange(high - low), cls] -= 1
    _descend(model.outer, model.outer_seen, p, rows, rate)
    a, b = np.searchsorted(e.at, (low, high))
    if a < b:
        rows, member, own = e.inner_rows[:, a:b], e.member[a:b], e.cls[e.at[a:b]]
        p = np.exp(log_softmax(model.inner, model.word_bias[own], rows))
        p[np.arange(b - a), member] -= 1
        _descend(model.inner, model.inner_seen, p, rows, rate)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of many texts, about ``CHUNK`` at a time; a longer text is one chunk."""
    held, size = [], 0
    for batch in batches:
        for raw in _texts(batch, column):
            held.append(keys_of(raw))
            size += len(held[-1])
            if size >= CHUNK:
                yield np.concatenate(held), np.array([len(k) for k in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(k) for k in held])


def trained(texts: DataFrame, counts: Counts, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model after one pass over all texts (``part``, ``text``), in ``rounds`` parts that follow each other.

    In a round each task starts from the same weights, takes gradient steps of ``BATCH`` tokens over its own texts, and gives the change of its weights
    times its tokens as whole numbers; these are summed up a tree of tasks, and their mean is added. A task's answer has a fixed size (some 4 MB), and sums
    of whole numbers come out alike in any order.
    """
    sc = texts.sparkSession.sparkContext
    model = untrained(counts)
    for part in range(rounds if counts.n_tokens else 0):
        held = sc.broadcast((model, counts))

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            start, counts = held.value
            own, seen = start.copy(), 0
            for keys, sizes in _chunks(batches, 0):
                e = events(keys, sizes, counts)
                for low in range(0, len(keys), BATCH):
                    update(own, e, low, min(low + BATCH, len(keys)), rate)
                seen += len(keys)
            if seen:
                weight = -(-seen // WEIGHED)
                change = np.rint((own.flat() - start.flat()) * UNIT).astype(np.int64) * weight
                yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([change.tobytes()], pa.binary())], names=["weight", "change"])

        changes = texts.where(F.col("part") == part).select("text").mapInArrow(learn, "weight long, change binary").rdd

        def add(total, row):
            return merge(total, (row[0], np.frombuffer(bytes(row[1]), np.int64)))

        def merge(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        # Changes stay below 2^6 in practice, so that 2^37 weights, some 10^14 tokens a round, fit into 63 bits.
        if (found := changes.treeAggregate(None, add, merge, depth=3)) is not None:
            model = model.moved(found[1].astype(np.float64) / found[0] / UNIT)
        held.destroy()
    return model


# --- scores ----------------------------------------------------------------------------------

PARTIAL_DDL = "doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, partial double, tail array<long>, times array<int>"


def partial_scores(keys: np.ndarray, sizes: np.ndarray, model: Model, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its place among the common words or -1, its log10 count + 1 there, and what of its log10 probability the model itself tells."""
    e = events(keys, sizes, counts)
    score = np.empty(len(keys))
    for low in range(0, len(keys), BATCH):
        high = min(low + BATCH, len(keys))
        score[low:high] = log_softmax(model.outer, model.class_bias, e.rows[:, low:high])[np.arange(high - low), e.cls[low:high]]
    for low in range(0, len(e.at), BATCH):
        at = e.at[low : low + BATCH]
        score[at] += log_softmax(model.inner, model.word_bias[e.cls[at]], e.inner_rows[:, low : low + BATCH])[np.arange(len(at)), e.member[low : low + BATCH]]
    score /= math.log(10)
    place = counts.place(keys)
    known = np.where(place >= 0, counts.log[np.maximum(place, 0)] if len(counts.log) else 0.0, 0.0)
    # A rarer word's share of its class: its count + 1 of the class's mass.
    rare = np.flatnonzero(e.cls >= HEAD_CLASSES)
    score[rare] += known[rare] - np.log10(counts.tail)[e.cls[rare] - HEAD_CLASSES]
    return place, known, score


def log_probabilities(docs: DataFrame, model: Model, counts: Counts, table: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row's text.

    Common words' counts are at hand; each text's other words, once a text with how often it has them, meet the counts by a shuffle on the word. None of them is
    a large part of the corpus the model has seen; one that is frequent only in held-out texts is split as a skewed key of the join.
    """
    held = docs.sparkSession.sparkContext.broadcast((model, counts))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_log", pa.float64()),
                        ("partial", pa.float64()), ("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = held.value

        def scored(rows: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(k) for k in texts])
            keys, ends = np.concatenate(texts), np.cumsum(sizes)
            place, known, score = partial_scores(keys, sizes, model, counts)
            n_head = np.add.reduceat((place >= 0).astype(np.int64), ends - sizes)
            logs, partial = np.add.reduceat(known, ends - sizes), np.add.reduceat(score, ends - sizes)
            tail, times = [], []
            for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                rare, n = np.unique(keys[start:end][place[start:end] < 0], return_counts=True)
                tail.append(rare.view(np.int64))
                times.append(n.astype(np.int32))
            columns = [[r[0] for r in rows], [r[1] for r in rows], sizes, n_head, logs, partial, tail, times]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        rows, texts, size = [], [], 0
        for batch in batches:
            for doc, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
                rows.append((doc, out))
                texts.append(keys_of(raw))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield scored(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield scored(rows, texts)

    known = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    partial = stage(known.mapInArrow(score, PARTIAL_DDL).withColumn("row", F.monotonically_increasing_id()))
    rare = partial.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("key"), F.col("w.times").alias("times"))
    found = rare.join(table, "key")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("rare_n"))
    more, zero = F.coalesce("rare_log", F.lit(0.0)), F.lit(0)
    n_tokens = F.col("n_tokens")
    return partial.drop("tail", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("rare_n", zero)).cast("long").alias("n_known"), F.lit(counts.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + more - n_tokens * F.lit(math.log10(counts.n_tokens + counts.n_words + 1))).alias("base_score"), (F.col("partial") + more).alias("score"),
    )


def score(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row: log10 probabilities of its whole text, its end included.

    1. Words of the rows that are not held out are counted: in each task, then by a shuffle on the word.
    2. The model is trained on the same rows (``trained``). The probability of a token is that of its class, times that of the word in the class. The class depends on
       hashed features of the text so far: the word before, the two words before, and, skipping, the words two and three before. The ``HEAD`` most frequent words lie in classes of
       ``MEMBERS``, within which they depend on such features again; all other words lie in classes by their endings, in which each weighs its count + 1, and one
       unknown word 1.
    3. Every row is scored in batches with sparse features.

    ``base_score`` is the add-one unigram score. What is broadcast has a fixed size: weights, and the counts of the ``COMMON`` most frequent words.
    Words are equal by 55 bits of a hash and their last two bytes. A null text counts as empty (an end alone); a null doc_id is not held out; rows
    count one by one, repeated ones too; without rows to learn from each text has only unknown words, of equal probability, and the base score is 0.
    No rows give no rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("part")
    train = rows.where(~held_out(F.col("doc_id"))).select(part, "text")
    table = stage(word_counts(train.select("text")))
    counts = counted(table)
    return log_probabilities(rows, trained(train, counts, rounds, rate), counts, table)
