"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session that runs in one process may do without: its own temporary folder is shared then."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    A lost executor then costs only the tasks it ran, and values from nondeterministic
    expressions (row numbers of a partition) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing reads them any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint only where the counted rows are few; else Spark chooses the join."""
    return F.broadcast(df) if rows <= most else df


def row_key(docs: DataFrame) -> Column:
    """A hash that is equal for rows of one doc_id and one text."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("\0")), F.coalesce(docs["text"], F.lit("\0")))


# --- hashing of words with numpy, whole batches at a time ------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# A byte's term of the polynomial: white space between words counts as nothing.
_VALUE = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint64)
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, for n positions."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)

        def series(base: int) -> np.ndarray:
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers, _inverse = series(_BASE), series(pow(_BASE, -1, 1 << 64))
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of UTF-8 bytes."""
    space = np.empty(len(raw) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def hashed_words(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One 64-bit hash for each word of UTF-8 bytes, a polynomial of its bytes, mixed; and its start and end byte."""
    start, end = word_bounds(raw)
    if not len(start):
        return np.empty(0, dtype=np.uint64), start, end
    power, inverse = _tables(len(raw) + 1)
    terms = (_LOWER_VALUE if lower else _VALUE)[raw]
    terms *= power[: len(raw)]
    sums = np.add.reduceat(terms, start) * inverse[start]
    return mix(sums + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def word_hashes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word."""
    return hashed_words(np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", dtype=np.uint8), lower)[0]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; for fewer words, one of the whole sequence."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i]
        out *= np.uint64(0xD1342543DE82EF95)
        out ^= out >> np.uint64(29)
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and each value once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Bitmaps have at most this many bits, 32 MB, however many values are marked.
MOST_BITS = 28


def bitmap_of(values: DataFrame) -> np.ndarray:
    """A bitmap in which the bit of each 64-bit value of the one column is set, for a broadcast.

    Its size follows the number of values up to a fixed bound; beyond it more bits are set by
    chance, so whoever asks must only spare work by a clear bit, never take a set one as proof.
    Values meet by the segment of the bitmap they fall in; only finished segments come to the driver.
    """
    kept = stage(values.toDF("value"))
    bits = min(MOST_BITS, max(16, int(32 * max(1, kept.count())).bit_length()))
    width = np.uint64(bits - 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            low = at & ((np.uint64(1) << width) - np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array((at >> width).astype(np.int32)), pa.array(low.astype(np.int32))], names=["segment", "low"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            which, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in distinct(which).tolist():
                held.setdefault(k, np.zeros(1 << int(width), dtype=bool))[low[which == k]] = True
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v).tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    part = 1 << (int(width) - 3)
    sent = kept.mapInArrow(place, "segment int, low int").repartition("segment").mapInArrow(fill, "segment int, bits binary")
    for row in sent.toLocalIterator():
        out[row["segment"] * part : (row["segment"] + 1) * part] |= np.frombuffer(row["bits"], dtype=np.uint8)
    unstage(kept)
    return out


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values' bits are set."""
    at = mix(values) >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
