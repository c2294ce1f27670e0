"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix, stage

#: Tables, hash functions of a table, buckets visited in each, and the width of a hash cell as a
#: multiple of the median distance to the 10th nearest of a sample of at most SAMPLE vectors.
TABLES, FUNCTIONS, PROBES, WIDTH, SAMPLE = 8, 8, 64, 1.85, 2048
#: Vectors of a bucket that one task reads; larger buckets are split.
BUCKET = 1024
#: A query with fewer than k rows, or whose k-th is farther than REACH widths, is ranked against all rows, in blocks of
#: BLOCK_ROWS rows and BLOCK_QUERIES queries. Distances up to COPY times the largest norm are between copies.
REACH, BLOCK_ROWS, BLOCK_QUERIES, COPY = 0.65, 16_384, 1024, 1e-6


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions, and offsets as shares of the width."""
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * functions)), rng.random(tables * functions)


@lru_cache(maxsize=8)
def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks of boundary distances, in the order of their expected score.

    Ranks 0 to 2 * functions - 1 stand for a query's sorted distances to the cell boundaries on either
    side; expected squares of these order statistics score a set, low scores succeed most. Sets grow
    from {0} by shifting or adding to their last rank; one holds no rank and its mirror, which
    are the two sides of one cell.
    """
    m = functions
    square = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out, heap = [()], [(square[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        if (last := ranks[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (score - square[last] + square[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + square[last + 1], (*ranks, last + 1)))
    return out


def bucket_numbers(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One number for each row of cells of a table."""
    out = np.full(len(cells), table * 1_000_003 + dim, dtype=np.uint64)
    for k in range(cells.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, k].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, for each dimension of a batch."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[ends[rows][:, None] + np.arange(dim)[None, :]]


def _placed(vectors: DataFrame, width: float, params: tuple[int, int, int, int], probe: bool, carry: bool) -> DataFrame:
    """``bucket, id, vector``: each vector in its bucket of each table, or in the buckets it visits."""
    tables, functions, probes, seed = params
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64())] + [("vector", pa.binary())] * carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = perturbations(functions, probes)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _vectors(batch.column(1)):
                directions, offsets = projections(x.shape[1], tables, functions, seed)
                at = x.astype(np.float64) @ directions / width + offsets
                cells = np.floor(at)
                packed = pa.array([v.tobytes() for v in x], pa.binary()) if carry else None
                for t in range(tables):
                    part = slice(t * functions, (t + 1) * functions)
                    own, f = cells[:, part], (at - cells)[:, part]
                    if probe:
                        # Column j < functions is the way to the cell below, the rest to the cell above.
                        ranked = np.argsort(np.concatenate([f, 1 - f], axis=1), axis=1, kind="stable")
                        moved = np.repeat(own[:, None, :], len(sets), axis=1)
                        for s, ranks in enumerate(sets):
                            for r in ranks:
                                j = ranked[:, r]
                                moved[np.arange(len(own)), s, j % functions] += np.where(j < functions, -1, 1)
                        own = moved.reshape(-1, functions)
                    each = len(sets) if probe else 1
                    numbers = bucket_numbers(own, t, x.shape[1])
                    for lo in range(0, len(rows), 512):
                        which = np.repeat(np.arange(lo, min(lo + 512, len(rows))), each)
                        columns = [pa.array(numbers[lo * each : (lo + 512) * each]), pa.array(ids[rows[which]])]
                        yield pa.RecordBatch.from_arrays(columns + ([packed.take(pa.array(which))] if carry else []), schema=schema)

    return vectors.mapInArrow(run, "bucket long, id long" + ", vector binary" * carry)


def _packed(vectors: DataFrame) -> DataFrame:
    """``dim, id, vector``: each vector as bytes, with its length."""
    schema = pa.schema([("dim", pa.int32()), ("id", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(1)):
                columns = [pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)), batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.mapInArrow(run, "dim int, id long, vector binary")


def cell_width(vectors: DataFrame, factor: float = WIDTH, most: int = SAMPLE) -> float:
    """``factor`` times the median distance to the 10th nearest that is no copy, in the sample with the least hashes of their ids."""
    # The ids first, so that repeated rows do not fill the sample.
    chosen = vectors.select("id").distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(most).select("id")
    rows = vectors.select("id", "vector").join(F.broadcast(chosen), "id", "left_semi").distinct().orderBy(F.xxhash64("id"), "id", "vector").limit(most).collect()
    distances = []
    for dim in {len(r["vector"]) for r in rows}:
        x = np.unique(np.array([r["vector"] for r in rows if len(r["vector"]) == dim], dtype=np.float64), axis=0)
        square = (x**2).sum(1)
        least = COPY * float(np.sqrt(square.max()))
        for lo in range(0, len(x), 256):
            d = np.sqrt(np.maximum(0, square[lo : lo + 256][:, None] + square[None] - 2 * x[lo : lo + 256] @ x.T))
            d = np.sort(np.where(d > least, d, np.inf), axis=1)
            others = np.isfinite(d).sum(1)
            distances += d[np.arange(len(d)), np.minimum(10, others) - 1][others > 0].tolist()
    return factor * float(np.median(distances)) if distances else 1.0


def _once(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted rows once."""
    first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])]) if len(ids) else np.empty(0, bool)
    return ids[first], score[first]


def _nearest(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, found_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the rows found, by (distance, id), in double precision."""
    q, x = queries.astype(np.float64), found.astype(np.float64)
    rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    # Rows of one id may be equally far, which gives one row: so many more than k are looked at.
    most = k + len(found_ids) - len(np.unique(found_ids))
    for i, own in enumerate(query_ids.tolist()):
        d = np.where(found_ids == own, np.inf, rough[i])
        near = np.flatnonzero(d <= (np.partition(d, most - 1)[most - 1] if len(d) > most else np.inf) + slack)
        near = near[found_ids[near] != own]
        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        best = np.lexsort((found_ids[near], exact))
        ids, score = _once(found_ids[near][best], exact[best])
        yield own, ids[:k], score[:k]


def _ranked(k: int, dtype: str):
    """The k nearest of each query over all buckets of a task, bucket by bucket."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: list[tuple] = []  # queries of the bucket being read
        bucket = None

        def merge(part: tuple[np.ndarray, np.ndarray]) -> None:
            ids, vectors = part
            if len(np.unique(ids)) < len(ids):  # equal rows count once, before they take up places
                rows = {(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True))}
                first = np.fromiter(rows.values(), dtype=np.int64, count=len(rows))
                ids, vectors = ids[first], vectors[first]
            asked = np.stack([np.frombuffer(v, dtype) for _, v in waiting])
            for own, near, score in _nearest(asked, np.array([i for i, _ in waiting]), vectors, ids, k):
                if own in best:
                    near, score = np.concatenate([best[own][0], near]), np.concatenate([best[own][1], score])
                    order = np.lexsort((near, score))
                    # A vector comes from several tables; equal rows stand next to each other.
                    near, score = _once(near[order], score[order])
                    near, score = near[:k], score[:k]
                best[own] = near, score

        def flush() -> Iterator[pa.RecordBatch]:
            for own, (near, score) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), own)), pa.array(near), pa.array(score)], schema=schema)
            best.clear()

        for batch in batches:
            keys, asks, ids, vectors = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), batch.column(4)
            parts = batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])]))
            for lo, hi in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                if (keys[lo], parts[lo]) != bucket:
                    bucket, waiting = (keys[lo], parts[lo]), []
                if asks[lo]:
                    waiting += zip(ids[lo:hi].tolist(), vectors[lo:hi].to_pylist(), strict=True)
                elif waiting:
                    for a in range(lo, hi, 4096):
                        b = min(hi, a + 4096)
                        merge((ids[a:b], np.stack([np.frombuffer(v.as_buffer(), dtype) for v in vectors[a:b]])))
            if len(best) > 200_000:
                yield from flush()
        yield from flush()

    return run


def _ranked_against_all(rows: DataFrame, asked: DataFrame, count: int, k: int, dtype: str) -> DataFrame:
    """``query_id, vec_id, score``: the k nearest of each of the ``count`` rows of ``asked`` in each block of ``rows``."""
    packed = _packed(asked).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // BLOCK_QUERIES)))))
    blocks = stage(packed.select("dim", "block").distinct())
    parts = max(1, -(-rows.count() // BLOCK_ROWS))
    bucket = ((F.col("dim").cast("long") * (1 << 32)) + F.col("block")).alias("bucket")
    index = _packed(rows).join(broadcast_if_small(blocks, blocks.count()), "dim")
    index = index.select(bucket, F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("ask"), "id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    met = index.unionByName(packed.select(bucket, every, F.lit(True).alias("ask"), "id", "vector"))
    met = met.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("ask"))
    return met.mapInArrow(_ranked(k, dtype), "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, width: float | None = None, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors`` found for each of ``queries``.

    Both hold ``id`` and ``vector`` (array of float or double). A table hashes a vector by several random Gaussian
    projections cut into cells; a query visits its own bucket of each table and those reached by
    small steps over near cell boundaries, in the order of their expected success. Whatever lies in a
    visited bucket is ranked by exact Euclidean distance, in double precision, ties by id.

    Vectors and probes meet by bucket; a bucket of more than BUCKET vectors is dealt out to
    several tasks, each of which gets its queries. A task sends on k rows a query at most.

    Queries that the visited buckets give fewer than k rows, or whose k-th row is farther than the probes
    reach (REACH widths), are ranked against all rows of their length, block by block; their rows are exact.

    Rows with a null id or an unusable vector (see ``usable``) take no part; vectors of another length
    are never found. Rows with the query's own id are left out, equal rows count once. A query has fewer than k rows only if
    fewer exist; rows of one id with several vectors are one query for all of them. No rows give no rows.
    """
    dtype = "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"
    rows, asked = (x.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("id"), "vector") for x in (vectors, queries))
    width = width or cell_width(rows)
    params = (tables, functions, probes, seed)
    large = _placed(rows, width, params, False, False).groupBy("bucket").count().where(F.col("count") > BUCKET)
    large = large.select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts"))
    # A table has at most one row for each BUCKET vectors; Spark chooses how to join it.
    index = _placed(rows, width, params, False, True).join(large, "bucket", "left")
    index = index.select("bucket", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.lit(False).alias("ask"), "id", "vector")
    probing = _placed(asked, width, params, True, True).join(large, "bucket", "left")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    probing = probing.select("bucket", parts, F.lit(True).alias("ask"), "id", "vector")
    met = index.unionByName(probing).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("ask"))
    found = met.mapInArrow(_ranked(k, dtype), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    top = lambda f: f.distinct().select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
    found = stage(top(found))
    served = found.where((F.col("rank") == k) & (F.col("score") <= REACH * width)).select(F.col("query_id").alias("id"))
    unserved = stage(asked.join(served, "id", "left_anti").select("id", "vector").distinct())
    if not (count := unserved.count()):
        return found
    # A query's own vectors may have met some buckets; all of its rows come from the exact ranking.
    kept = found.join(served, found["query_id"] == served["id"], "left_semi")
    return kept.unionByName(top(_ranked_against_all(rows, unserved, count, k, dtype)))
