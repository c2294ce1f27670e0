"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: The only special token of the vocabulary (a fixed value).
_SPECIAL = "<|endoftext|>"
#: How a byte-level vocabulary cuts a text into words (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(vocabulary: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary file and their ids, which follow the order of its merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, before = whole["model"]["vocab"], whole.get("pre_tokenizer") or {}
    plain = whole["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not whole.get("normalizer")
    if not plain or [t["content"] for t in whole.get("added_tokens", [])] != [_SPECIAL]:
        raise ValueError("only byte-level vocabularies without prefix space, with one special token, are read")
    return {bytes(byte_of[c] for c in token): n for token, n in vocab.items() if token != _SPECIAL}


@lru_cache(maxsize=2)
def token_encoder(vocabulary: str):
    """text -> ids as little-endian uint32 bytes, the same as the tokenizer's own.

    The vocabulary's merges run in ``tiktoken``, which gives the ids of ``tokenizers`` for a
    byte-level vocabulary in a third of its time (tests compare both).
    """
    import tiktoken

    special = {_SPECIAL: len(ranks := _ranks(vocabulary))}
    encode = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
    return lambda text: encode(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut where they exceed a sequence.

    Only a document longer than ``capacity`` is cut; its first piece takes the remainder, the others are full. A null text
    is an empty one, whose only id is ``end_id``. Rows count one by one; no rows give no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                stops = list(range((n - 1) % capacity + 1, n + 1, capacity))
                out += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    cut_schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, cut_schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the fullest bin that has room.

    The bits of one integer mark the rooms that open bins have, so the tightest one is found
    without a search.
    """
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins


BIN = "sequence_id long, size long, items array<bigint>, sizes array<bigint>"


def _pack(level: int, capacity: int):
    """A task's bins, packed best-fit into new ones."""
    schema = pa.schema([("sequence_id", pa.int64()), ("size", pa.int64()), ("items", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by their least item, so that a task that runs again packs alike.
        found = sorted(((x["items"], x["sizes"]) for b in batches for x in b.to_pylist()), key=lambda x: x[0][0])
        fills = np.array([sum(s) for _, s in found], dtype=np.int64)
        part = TaskContext.get().partitionId()
        rows = []
        for n, members in enumerate(best_fit(fills, capacity)):
            size = int(fills[members].sum())
            items, sizes = ([x for m in members for x in found[m][k]] for k in (0, 1))
            rows.append((level << 56 | part << 32 | n, size, items, sizes))
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 5000], strict=True), schema, strict=True)], schema=schema)

    return pack


def hierarchical_pack(pieces: DataFrame, capacity: int = 1024, local: int = 50_000, fan_in: int = 8) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) and where each goes: ``sequence_id``, ``offset``.

    A piece of full length is a sequence of its own. Round 0 deals the others out evenly, about ``local`` to a task, and packs each
    task's best-fit. Each round has ``fan_in`` times fewer tasks than the one before, down to one. After every round but the last,
    the fullest bins are emitted: those that the smallest bin left no longer fits in, and beyond them as many as must go for the
    next round's tasks to hold about ``local`` pieces each. The emptier bins go on whole, as items, and are packed best-fit again. Bins
    of half the capacity or less always go on; best-fit leaves at most one of them in a task, so a task gets about
    ``fan_in`` of them. A bin carries its items' numbers, at most ``capacity``.
    What n pieces of a task miss by is about the square root of n, so ``local`` bounds the waste.

    Pieces longer than ``capacity`` are refused. No rows give no rows. Rows count one by one; all columns stay, but
    for ones named ``pk_item``, ``sequence_id`` or ``offset``, which give way to this operator's own.
    """
    numbered = stage(pieces.drop("pk_item", "sequence_id", "offset").withColumn("pk_item", F.monotonically_increasing_id()))
    count, longest = numbered.agg(F.count_if(F.col("length") < capacity), F.max("length")).first()
    if longest is not None and longest > capacity:
        raise ValueError(f"a piece of {longest} is longer than a sequence of {capacity}")
    item, whole = F.col("pk_item"), F.col("length") == capacity
    alone = numbered.where(whole).select((item + (1 << 62)).alias("sequence_id"), item.alias("pk_item"), F.lit(0).cast("long").alias("offset"))
    waiting = numbered.where(~whole).select(F.array(item).alias("items"), F.array(F.col("length").cast("long")).alias("sizes"))
    tasks, level, packed = max(1, -(-count // local)), 0, []
    while True:
        dealt = waiting.select("items", "sizes").repartition(tasks, F.xxhash64(F.element_at("items", 1), F.lit(level)))
        bins = stage(dealt.mapInArrow(_pack(level, capacity), BIN))
        if tasks == 1:
            packed.append(bins)
            break
        tasks, level = -(-tasks // fan_in), level + 1
        # One row a size, at most capacity.
        pieces_of = sorted((r["size"], r["n"]) for r in bins.groupBy("size").agg(F.sum(F.size("items")).alias("n")).collect())
        if not pieces_of:
            break
        least, room, largest = pieces_of[0][0], tasks * local, 0
        for size, n in pieces_of:
            room -= n
            if size > capacity // 2 and (room < 0 or size + least > capacity):
                break
            largest = size
        packed.append(bins.where(F.col("size") > largest))
        waiting = bins.where(F.col("size") <= largest)
    done = packed[0]
    for more in packed[1:]:
        done = done.unionByName(more)
    before = F.transform("sizes", lambda _, k: F.aggregate(F.slice("sizes", 1, k), F.lit(0).cast("long"), lambda a, b: a + b))
    placed = done.select("sequence_id", F.explode(F.arrays_zip(F.col("items").alias("pk_item"), before.alias("offset"))).alias("x")).select("sequence_id", "x.*")
    return numbered.join(placed.unionByName(alone), "pk_item").drop("pk_item")
