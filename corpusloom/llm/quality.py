"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shingle_hashes, stage, unstage, word_hashes

#: Indicators are hashed to this many columns, so weights have a fixed size.
BITS = 18
#: The most labelled rows a model is fitted on: those with the least hash of their doc_id.
MAX_ROWS = 8192
#: The most indicators that these rows have together (128 MB on the driver); rows of long texts beyond it are left out, in the order of that hash.
MAX_VALUES = 1 << 25
#: How many labelled rows of these are kept back to turn margins into probabilities.
CALIBRATE = 5


def indicators(text: str | None) -> np.ndarray:
    """The columns a text has: its words, pairs of words and runs of three bytes, each once."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int32)
    words = word_hashes(raw.tobytes(), lower=True)
    parts = [words, shingle_hashes(words, 2) if len(words) > 1 else words[:0]]
    if len(raw) > 2:
        b = raw.astype(np.uint64)
        parts.append(((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    columns = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)
    # Each column once, without a sort: the last writer of a cell stays.
    cells = _cells()
    order = np.arange(len(columns), dtype=np.int32)
    cells[columns] = order
    return columns[cells[columns] == order]


_held: list[np.ndarray] = []


def _cells() -> np.ndarray:
    if not _held:
        _held.append(np.zeros(1 << BITS, dtype=np.int32))
    return _held[0]


@dataclass
class Model:
    """Weights of the columns (already times their log-count ratios), and the logistic scale of margins."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum() / max(1.0, len(columns)) ** 0.5) + self.bias

    def score(self, columns: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(columns) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of how much likelier each indicator is among label 1 than among label 0."""
    counts = [np.full(1 << BITS, smooth) for _ in range(2)]
    for columns, y in zip(rows, labels, strict=True):
        counts[int(y)][columns] += 1
    return np.log(counts[1] / (labels.sum() + 2 * smooth)) - np.log(counts[0] / ((1 - labels).sum() + 2 * smooth))


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model on ratio-scaled, length-normed indicators.

    Each step solves one row's dual variable exactly within [0, its cost]; costs even out the classes.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())]) / len(labels)
    costs = cost * 0.5 / share[labels.astype(int)]
    # A row's values are made when it is visited; only the lists themselves are held.
    value = lambda c: ratios[c] / max(1.0, len(c)) ** 0.5
    norms = np.array([float(v @ v) + 1.0 for v in map(value, rows)])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            v = value(rows[i])
            gradient = y[i] * (v @ weights[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if step := (new - alpha[i]) * y[i]:
                weights[rows[i]] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights * ratios, bias


def logistic_scale(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method with a weak prior."""
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    aim = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - aim) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model; without rows of both classes its score is the smoothed share of label 1."""
    labels = np.asarray(labels, dtype=np.float64)
    kept = np.arange(len(labels)) % CALIBRATE == CALIBRATE - 1
    both = lambda m: len(set(labels[m])) == 2
    if not both(slice(None)) or not both(~kept):
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    train = [r for r, k in zip(rows, kept, strict=True) if not k]
    ratios = log_count_ratios(train, labels[~kept])
    weights, bias = dual_coordinate_descent(train, labels[~kept], ratios)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    on = kept if both(kept) else ~kept
    margins = np.array([model.margin(r) for r, k in zip(rows, on, strict=True) if k])
    model.slope, model.offset = logistic_scale(margins, labels[on])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from; a null doc_id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``columns, label, order`` of at most ``max_rows`` labelled documents outside the held-out fifth, one row each.

    Rows with a null doc_id or label are left out; of several labels of a doc_id the most frequent counts, 1 in a tie.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    voted = known.groupBy(F.col("doc_id").cast("long").alias("lb_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("lb_label"))
    chosen = voted.withColumn("lb_order", F.xxhash64("lb_id")).orderBy("lb_order", "lb_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("lb_id"), F.col("text").alias("lb_text"))
    # At most max_rows numbers are broadcast.
    found = rows.join(F.broadcast(chosen), "lb_id")
    # Of a repeated doc_id one text counts: the one with the least hash.
    least = F.min(F.struct(F.xxhash64("lb_text").alias("lb_hash"), "lb_text")).alias("lb_least")
    picked = found.groupBy("lb_id", "lb_label", "lb_order").agg(least).select("lb_least.lb_text", "lb_label", "lb_order")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([indicators(t.as_py()) for t in b.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, b.column(1), b.column(2)], names=["columns", "label", "order"])

    return picked.mapInArrow(columns, "columns array<int>, label int, order long")


def within(sample: DataFrame, max_values: int) -> DataFrame:
    """The first rows of a staged sample, by ``order``, whose lists together hold at most ``max_values`` indicators. The window sees at most ``MAX_ROWS`` pairs of numbers."""
    before = F.sum("n").over(Window.orderBy("order", "label").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sample.select("order", "label", F.size("columns").cast("long").alias("n")).withColumn("upto", before)
    last = sizes.where(F.col("upto") <= max_values).agg(F.max("order")).first()[0]
    return sample.where(F.col("order") <= F.lit(last)) if last is not None else sample.limit(0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_values: int = MAX_VALUES) -> Model:
    """The model of a sample of labelled rows, bounded in rows and in indicators; reruns give the same one.

    Of rows with one doc_id one counts; without rows or labels of both classes the score is the same for every text.
    """
    staged = stage(labelled_sample(docs, labels, max_rows))
    sample = within(staged, max_values).toArrow()
    unstage(staged)
    order = np.lexsort((sample["label"].to_numpy(), sample["order"].to_numpy())) if len(sample) else np.empty(0, int)
    lists = sample["columns"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    rows = [values[ends[i] : ends[i + 1]] for i in order[:max_rows]]
    return fit(rows, sample["label"].to_numpy()[order[:max_rows]] if len(rows) else np.empty(0))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs``, with ``qc_score`` (0 to 1) and ``qc_predicted`` of each whole text; columns of these two names are replaced.

    One pass without a shuffle; the weights have a fixed size. Only the text is read for a score; a
    null text scores as an empty one. Rows count one by one; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        m = held.value
        return pa.array([m.score(indicators(t.as_py())) for t in texts], pa.float64())

    scored = docs.withColumn("qc_score", of(F.col("text").cast("string")))
    return scored.withColumn("qc_predicted", (F.col("qc_score") >= threshold).cast("int"))
