"""Centroid clustering of integer vectors: distances by blocked matrix products, sums by a tree of tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, unstage

#: Rows of a block: one matrix product each.
BLOCK = 2048
#: float64 holds every integer up to here; int64 up to there.
EXACT, LONG = 2**53, 2**63
#: Stored component types, narrowest first, and their bounds; what fits none is kept as decimal text.
KINDS = (("i2", 2**15), ("i4", 2**31), ("i8", 2**62))
BLOCK_DDL = "ids binary, known binary, kind string, data binary"
BLOCK_SCHEMA = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("kind", pa.string()), ("data", pa.binary())])


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: as int64, or as Python integers where one does not fit."""
    if not values.size or np.abs(values).max() < 2**52 / scale:
        return np.floor(values * scale).astype(np.int64)

    def one(x: float) -> int:
        top, bottom = x.as_integer_ratio()
        return top * scale // bottom

    return np.array([[one(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def bound(x: np.ndarray) -> int:
    """The largest magnitude of a matrix, as a Python integer."""
    return int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0


def pack(ids: np.ndarray, known: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes, str, bytes]:
    """A block as bytes, in the narrowest type that holds it."""
    most = bound(x)
    kind = next((k for k, top in KINDS if most < top), "text")
    data = " ".join(map(str, x.ravel().tolist())).encode() if kind == "text" else x.astype(f"<{kind}").tobytes()
    return ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), kind, data


def unpack(kind: str, data: bytes, dim: int) -> np.ndarray:
    """A block's matrix: int64, or Python integers."""
    if kind == "text":
        return np.array([int(v) for v in data.split()], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, dtype=f"<{kind}").reshape(-1, dim).astype(np.int64)


def blocks_of(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """``vectors`` (id, vector) as blocks of at most ``BLOCK`` rows; vectors of another length, or with null or non-finite components, are left out."""

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fits = pa.compute.equal(pa.compute.list_value_length(column), dim)
            kept = batch.filter(pa.compute.fill_null(fits, False))
            for k in range(0, len(kept), BLOCK):
                part = kept.slice(k, BLOCK)
                lists = part.column(1)
                flat = lists.flatten()
                nulls = np.asarray(flat.is_null()).reshape(-1, dim).any(axis=1)
                values = pa.compute.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                good = np.isfinite(values).all(axis=1) & ~nulls
                if good.any():
                    ids, known = part.column(0).fill_null(0).to_numpy(), np.asarray(part.column(0).is_valid())
                    row = pack(ids[good], known[good], scaled(values[good], scale))
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(to_blocks, BLOCK_DDL)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Every row's exact squared distance to every centroid.

    The expansion |x|^2 - 2x.c + |c|^2 runs as one float64 matrix product where (|x| + |c|)^2 summed over the components stays
    below 2^53: each of its terms and partial sums is then an integer that float64 holds. Beyond that bound whole numbers are subtracted and
    squared: int64 below 2^63, Python integers above.
    """
    reach = x.shape[1] * (bound(x) + bound(c)) ** 2
    if reach < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        out = a @ (-2.0 * b.T)
        out += (a * a).sum(axis=1)[:, None]
        out += (b * b).sum(axis=1)
        return out
    kind = np.int64 if reach < LONG else object
    x, c = x.astype(kind), c.astype(kind)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def assigned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and its squared distance, as int64 or Python integers.

    Rows and centroids are split by magnitude first, so that a few large ones do not take the rest off the matrix product.
    """
    limit = math.isqrt((EXACT - 1) // x.shape[1]) // 2
    small = lambda m: np.array([max(abs(int(r.max())), abs(int(r.min()))) < limit for r in m], dtype=bool) if bound(m) >= limit else np.ones(len(m), dtype=bool)
    near, light = small(x), small(c)
    if near.all() and light.all():
        d = squared_distances(x, c)
        at = d.argmin(axis=1)
        best = d[np.arange(len(x)), at]
        return at, best if best.dtype == object else best.astype(np.int64)
    at, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), None, dtype=object)
    for rows in (np.flatnonzero(near), np.flatnonzero(~near)):
        for columns in (np.flatnonzero(light), np.flatnonzero(~light)):
            if not len(rows) or not len(columns):
                continue
            d = squared_distances(x[rows], c[columns])
            k = d.argmin(axis=1)
            for r, j, v in zip(rows.tolist(), columns[k].tolist(), d[np.arange(len(rows)), k].tolist(), strict=True):
                if best[r] is None or (int(v), j) < (best[r], at[r]):
                    best[r], at[r] = int(v), j
    return at, best


class Sums:
    """Per cluster: how many vectors, the sum of their components and of their distances. Its size does not depend on the rows."""

    def __init__(self, k: int, dim: int):
        self.count, self.total, self.inertia, self.most = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, dtype=object), 0

    def _hold(self, most: int) -> None:
        """Beyond int64 the totals go on as Python integers."""
        self.most += most
        if self.most >= 2**62 and self.total.dtype != object:
            self.total = self.total.astype(object)

    def add(self, x: np.ndarray, c: np.ndarray) -> Sums:
        at, distance = assigned(x, c)
        self._hold(len(x) * bound(x))
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        self.count += np.bincount(at, minlength=len(self.count))
        self.total[found] = self.total[found] + np.add.reduceat(x[order], first, axis=0)
        # Distances below 2^53, 2,048 a block: their sums fit.
        wide = distance if distance.dtype != object and bound(distance) * len(x) < LONG else distance.astype(object)
        self.inertia[found] = self.inertia[found] + np.add.reduceat(wide[order], first).astype(object)
        return self

    def merge(self, other: Sums) -> Sums:
        self._hold(other.most)
        self.count, self.total, self.inertia = self.count + other.count, self.total + other.total, self.inertia + other.inertia
        return self


def gathered(blocks: DataFrame, c: np.ndarray) -> Sums:
    """The sums of all blocks under the centroids: folded in each task, merged up a tree of tasks."""
    spark = blocks.sparkSession
    held, dim = spark.sparkContext.broadcast(c), c.shape[1]
    rdd: RDD = blocks.select("kind", "data").rdd
    return rdd.treeAggregate(Sums(len(c), dim), lambda s, row: s.add(unpack(row[0], bytes(row[1]), dim), held.value), lambda a, b: a.merge(b), depth=3)


def start_key(vec_id: Column, seed: int) -> Column:
    """What the first centroids are chosen by; rows without a number come last."""
    return F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256), F.lit("~"))


def starts(vectors: DataFrame, k: int, dim: int, scale: int, seed: int) -> np.ndarray:
    """The first ``k`` centroids: the vectors with the least digests, at most ``k`` rows on the driver. Equal digests go by the vectors' components."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where((F.size("vector") == dim) & whole)
    chosen = rows.withColumn("key", start_key(F.col("id"), seed)).orderBy("key", "vector").limit(k).collect()
    return scaled(np.array([r["vector"] for r in chosen], dtype=np.float64).reshape(-1, dim), scale)


def moved(c: np.ndarray, sums: Sums) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    rows = [[int(t) // int(n) for t in total] if n else [int(v) for v in old] for old, total, n in zip(c, sums.total, sums.count, strict=True)]
    out = np.array(rows, dtype=object)
    return out.astype(np.int64) if bound(out) < 2**62 else out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of the columns ``id, vector``, after ``rounds`` rounds of Lloyd's method on whole numbers.

    Components become floor(scale * x). Blocks of rows are written down once, as narrow integers; every round reads them, takes distances by matrix
    products (``squared_distances``), folds one fixed-size sum a task and merges these up a tree (``treeAggregate``). The driver and every task hold
    ``k`` centroids and ``k`` sums, whatever the rows and however many share a cluster. All sums are exact, so reruns agree and a lost task repeats its own.

    Null vectors and vectors of another length or with null or non-finite components are left out. Rows count one by one: repeated rows all
    weigh and all come back; a null id comes back as null and starts no centroid unless fewer than ``k`` others are there. With fewer vectors than ``k`` there are as many
    centroids; without any, no rows. Ties go to the smaller centroid. Distances and inertias beyond a long are null.
    """
    spark: SparkSession = vectors.sparkSession
    ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    c = starts(vectors, k, dim, scale, seed)
    if not len(c):
        return spark.createDataFrame([], ddl)
    blocks = stage(blocks_of(vectors, dim, scale))
    for _ in range(rounds):
        c = moved(c, gathered(blocks, c))
    inertia = gathered(blocks, c).inertia.tolist()
    shown = [",".join(str(int(v)) for v in row) for row in c]
    held = spark.sparkContext.broadcast((c, inertia, shown))
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid", pa.string())])
    fits = lambda v: int(v) if int(v) < LONG else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, inertia, shown = held.value
        whole = fits(sum(inertia))
        for batch in batches:
            for ids, known, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, distance = assigned(unpack(kind, data, dim), c)
                numbers = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, np.uint8) == 0)
                far = pa.array(distance) if distance.dtype != object else pa.array([fits(v) for v in distance], pa.int64())
                own = pa.array([fits(v) for v in inertia], pa.int64()).take(pa.array(at))
                names = pa.array(shown, pa.string()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(at.astype(np.int32)), far, own, pa.array([whole] * len(at), pa.int64()), names], schema=schema)

    return blocks.mapInArrow(rows, ddl)


def _round(k: int) -> str:
    """The assignment under the centroids of round ``k``, and the centroids that follow."""
    return f"""
, pair{k} AS MATERIALIZED (
    SELECT v.n, v.vec_id, c.cluster, list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM kept v, mean{k} c
), near{k} AS MATERIALIZED (
    SELECT n, vec_id, d AS distance, cluster FROM pair{k} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, cluster) = 1
), part{k} AS (
    SELECT a.cluster, i, sum(v.x[i]) AS s, count(*) AS m FROM near{k} a JOIN kept v USING (n), generate_series(1, 64) g(i) GROUP BY 1, 2
), mean{k + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(p.x, c.x) AS x FROM mean{k} c
    LEFT JOIN (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS x FROM part{k} GROUP BY 1) p USING (cluster)
)"""


def clusters_sql(rounds: int = 5) -> str:
    """The same rounds with a pair for every vector and centroid; for the small tables."""
    return f"""
WITH valid AS (
    SELECT vec_id, embedding FROM {{embeddings}}
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM valid
), mean0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS cluster, x FROM kept ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x LIMIT 40
){"".join(_round(k) for k in range(rounds + 1))}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
    CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.x, lambda v: CAST(v AS VARCHAR)), ',')) AS centroid_sha256
FROM near{rounds} a JOIN mean{rounds} c USING (cluster)
"""
