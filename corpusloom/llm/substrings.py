"""Substring dedup by relative Lempel-Ziv parsing against an index of all reference blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, distinct, marked, shingle_hashes, stage, unstage, word_hashes

#: Words of an anchor. A phrase of n words holds n - ANCHOR + 1 of them, and the one with the least
#: hash is chosen in every document that has the phrase.
ANCHOR = 6
#: Phrases of an index block.
BLOCK_ROWS = 2_000_000
_NONE = np.iinfo(np.int64).max


def anchors_of_phrases(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase of n words, its hash and the hash of its anchor."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    parts = shingle_hashes(words, ANCHOR)
    # The least of each run, by doubling: runs of 1, 2, 4 ... up to the length wanted.
    least, have, want = parts, 1, n - ANCHOR + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return shingle_hashes(words, n), least


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _doc_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """doc_id (a null one after all others) and text bytes of a batch."""
    ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
    return ids, [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]


def _once(batch: pa.RecordBatch) -> list[tuple[int, bytes]]:
    """The doc_ids and texts of a batch, repeated rows once."""
    ids, texts = _doc_keys(batch)
    return list(dict.fromkeys(zip(ids.tolist(), texts, strict=True)))


def text_tag(raw: bytes) -> int:
    """Tells apart texts under one doc_id: the upper 31 bits of a CRC-32."""
    return zlib.crc32(raw) >> 1


def shared_anchors(rows: DataFrame, n: int) -> DataFrame:
    """Hashes of the anchors that two or more documents have."""
    schema = pa.schema([("anchor", pa.int64()), ("shared", pa.bool_())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _doc_keys(batch)
            found = [distinct(anchors_of_phrases(word_hashes(t), n)[1]) for t in texts]
            order = np.argsort(ids, kind="stable")
            # A document's rows count once: the anchors of one doc_id are made distinct together.
            pairs = [found[group[0]] if len(group) == 1 else distinct(np.concatenate([found[i] for i in group])) for group in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(group)]
            values = np.sort(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
            counts = np.diff(np.append(edge, len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values[edge])), pa.array(counts > 1)], schema=schema)

    # Each batch sends an anchor once, so a hot one comes once from each batch.
    found = rows.mapInArrow(index, "anchor long, shared boolean")
    return found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("shared").alias("shared")).where("n > 1 OR shared").select("anchor")


def anchor_places(words: np.ndarray, n: int) -> np.ndarray:
    """Where an anchor of some phrase of n words stands and a phrase of n words starts, with the anchor's hash.

    Neighbouring ones are at most n - ANCHOR + 1 words apart, so the phrases that start at them overlap.
    """
    parts = shingle_hashes(words, ANCHOR)
    _, least = anchors_of_phrases(words, n)
    if not len(least):
        return np.empty(0, np.int64)
    # A place is an anchor if the greatest of the leasts of all phrases over it is its own hash.
    span = n - ANCHOR + 1
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    top, have = padded, 1
    while have < span:
        step = min(have, span - have)
        top = np.maximum(top[: len(top) - step], top[step:])
        have += step
    return np.flatnonzero(top[: len(least)] == parts[: len(least)])


#: A phrase's hash, and where it starts: its document, and ``at`` with the tag of its text in the upper half.
PHRASE = [("phrase", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())]
#: The least document (and place in it) where the phrase starts; ``length`` words from ``at`` on are found there.
FOUND = pa.schema([*PHRASE, ("source", pa.int64()), ("place", pa.int64()), ("length", pa.int32())])
FOUND_DDL = "phrase long, doc long, at long, source long, place long, length int"
_LOW = (1 << 32) - 1


def _least(phrase: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least document of its phrase, and the least place in it."""
    order = np.lexsort((at, doc, phrase))
    edge = np.flatnonzero(np.concatenate([[True], phrase[order][1:] != phrase[order][:-1]])) if len(order) else order
    out = np.empty((2, len(doc)), np.int64)
    for k, column in enumerate((doc, at)):
        out[k, order] = np.repeat(column[order][edge], np.diff(np.append(edge, len(doc))))
    return out[0], out[1]


def _asked(phrase: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of phrases that ask the index. Those of a document that is not their least one here have found a
    source at once, so a hot phrase reaches the index once a batch."""
    source, place = _least(phrase, doc, at)
    known = source < doc
    columns = (phrase, doc, at, np.where(known, source, _NONE), place, np.full(len(doc), n, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def looked_up(asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (staged) whose phrase starts in a document with a smaller number, with its source.

    The index of the reference is cut into blocks by phrase hash; in a block, sorted by phrase, document and place, the first
    row of a phrase is its source, and rows stream past it whatever their number.
    """
    open_rows = asked.where((F.col("source") == _NONE) & (F.col("length") > 0) & F.col("phrase").isNotNull())
    blocks = max(1, -(-open_rows.count() // BLOCK_ROWS), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            if not len(batch):
                continue
            phrase, doc, at = (batch.column(k).to_numpy() for k in range(3))
            new = np.concatenate([[last is None or last[0] != phrase[0]], phrase[1:] != phrase[:-1]])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            held = (np.concatenate([[last[k + 1] if last else 0], c[first]])[group + 1] for k, c in enumerate((doc, at)))
            source, place = held
            last = (int(phrase[-1]), int(source[-1]), int(place[-1]))
            keep = source < doc
            columns = (phrase, doc, at, source, place, batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c[keep], f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    resolved = open_rows.repartition(blocks, "phrase").sortWithinPartitions("phrase", "doc", "at").mapInArrow(resolve, FOUND_DDL)
    return asked.where(F.col("source") != _NONE).unionByName(resolved)


def _by_text(found: DataFrame, *columns: str) -> DataFrame:
    """``doc, tag, hits``: what was found of each text, once however many rows have it."""
    at = F.col("at").bitwiseAND(F.lit(_LOW)).cast("int").alias("at")
    rows = found.select("doc", F.shiftright("at", 32).alias("tag"), F.struct(at, *columns).alias("hit"))
    return rows.groupBy("doc", "tag").agg(F.collect_set("hit").alias("hits"))


def _hits(batch: pa.RecordBatch, column: int) -> Iterator[list[np.ndarray] | None]:
    """The fields of each row's list of structs, or None."""
    hits = batch.column(column)
    if not len(hits):
        return
    ends, inner = hits.offsets.to_numpy(), hits.values
    fields = [inner.field(k).to_numpy(zero_copy_only=False) for k in range(inner.type.num_fields)]
    for k in range(len(hits)):
        yield [f[ends[k] : ends[k + 1]] for f in fields] if hits[k].is_valid and ends[k + 1] > ends[k] else None


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The longest factors that the seeds of a text give: start, length, source.

    Each seed is n words that stand at ``place`` in its source. A factor is drawn out from seed to seed as long as the next one
    stands in the same text of the reference, as many words further on, and overlaps what is matched so far.
    """
    order = np.lexsort((place, source, at))
    order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
    at, source, place = at[order].astype(np.int64), source[order], place[order]
    # The place holds the source text's tag too, so that equal differences mean one text.
    on = (at[1:] - at[:-1] <= n) & (source[1:] == source[:-1]) & (place[1:] - place[:-1] == at[1:] - at[:-1])
    edge = np.flatnonzero(np.concatenate([[True], ~on]))
    stop = np.append(edge[1:], len(at)) - 1
    return list(zip(at[edge].tolist(), (at[stop] - at[edge] + n).tolist(), source[edge].tolist(), strict=True))


def joined_factors(at: np.ndarray, length: np.ndarray, source: np.ndarray) -> list[tuple[int, int, int]]:
    """Factors and the phrases found at their boundaries, drawn out over each other where they have one source."""
    out: list[list[int]] = []
    for start, size, of in sorted(set(zip(at.tolist(), length.tolist(), source.tolist(), strict=True))):
        if out and out[-1][2] == of and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size - out[-1][0])
        else:
            out.append([start, size, of])
    return [tuple(x) for x in out]


SPANS = "array<struct<start:int,length:int,source:bigint>>"


def drop_repeated_passages(docs: DataFrame, n: int = 13) -> DataFrame:
    """``doc_id, text, words, removed, spans`` without passages that an earlier document has.

    Relative Lempel-Ziv parsing against a reference that is the whole corpus, cut into blocks by phrase hash:

    1. The index holds the phrases of ``n`` words that start at an anchor (about one word in five), with the least document and
       place where each starts. A document's anchored phrases are its seeds, looked up in every block.
    2. A document is parsed greedily: a factor starts at a seed and is drawn out from seed to seed to its longest, while its
       source goes on alike. Seeds overlap, so every word of a factor is compared. What lies inside a factor is not looked up again.
    3. At the factors' boundaries, and where no factor is, the remaining phrases are looked up one by one in an index of such phrases. It is
       complete: the least document that has a phrase has it outside of its factors.

    Factors and boundary phrases (``n`` words or more) become the duplicate spans, and each word that one covers is removed, judged on the input.
    Anchors that two documents share are found first; the bitmap that carries them has a fixed largest size and
    only spares phrases that cannot recur from the shuffle; the phrases are compared by 64-bit hashes.

    A null text has no words (and stays an empty text); a null doc_id counts as the largest and is never a source; rows with
    equal doc_id are no source for each other. ``text`` is what is left, its words joined by one blank.
    No rows give no rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(shared_anchors(rows, n)))
    tag = F.shiftright(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), 1)
    keyed = rows.withColumn("tag", tag).withColumn("doc", F.coalesce("doc_id", F.lit(_NONE)))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i, raw in _once(batch):
                words = word_hashes(raw)
                at = anchor_places(words, n)
                if len(at):
                    at = at[marked(bitmap.value, shingle_hashes(words, ANCHOR)[at])]
                if len(at):
                    held.append((shingle_hashes(words, n)[at].view(np.int64), np.full(len(at), i, np.int64), at | text_tag(raw) << 32))
            if held:
                yield _asked(*(np.concatenate(c) for c in zip(*held, strict=True)), n)

    asked = stage(rows.mapInArrow(seeds, FOUND_DDL))
    parsed = keyed.join(_by_text(looked_up(asked), "source", "place"), ["doc", "tag"], "left").select("doc_id", "text", "hits")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _doc_keys(batch)
            held, spans, seen = [], [], set()
            for i, raw, hit in zip(ids.tolist(), texts, _hits(batch, 2), strict=True):
                # Repeated rows ask once.
                if (i, raw) in seen:
                    continue
                seen.add((i, raw))
                hashes, anchors = anchors_of_phrases(word_hashes(raw), n)
                ask, upper = marked(bitmap.value, anchors), text_tag(raw) << 32
                for start, length, source in factors(*hit, n) if hit else ():
                    ask[start : start + length - n + 1] = False
                    spans.append((None, i, start | upper, source, None, length))
                if len(at := np.flatnonzero(ask)):
                    held.append((hashes[at].view(np.int64), np.full(len(at), i, np.int64), at | upper))
            if held:
                yield _asked(*(np.concatenate(c) for c in zip(*held, strict=True)), n)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spans, strict=True), FOUND, strict=True)], schema=FOUND)

    rest = stage(parsed.mapInArrow(parse, FOUND_DDL))
    unstage(asked)
    joined = keyed.join(_by_text(looked_up(rest), "length", "source"), ["doc", "tag"], "left")
    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("words", pa.int64()), ("removed", pa.int64()), ("spans", pa.list_(span))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, hit in zip(batch.column(0).to_pylist(), batch.column(1), _hits(batch, 2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                spans, kept = joined_factors(*hit) if hit else [], words
                if spans:
                    keep = np.ones(len(words), dtype=bool)
                    for start, length, _ in spans:
                        keep[start : start + length] = False
                    kept = list(compress(words, keep))
                out.append((i, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), [dict(zip(("start", "length", "source"), s, strict=True)) for s in spans]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.select("doc_id", "text", "hits").mapInArrow(cut, f"doc_id long, text string, words long, removed long, spans {SPANS}")
