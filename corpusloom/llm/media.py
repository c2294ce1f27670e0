"""Media columns: MPEG transport streams written, parsed and checked inside Spark tasks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the container format.
SYNC, PACKET, CLOCK = 0x47, 188, 90_000
PAT_PID, PMT_PID, MEDIA_PID = 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
UNIT, TICKS, EVERY = 3072, 3600, 8  # bytes and clock ticks of an access unit; one in EVERY is a random-access point
STEP = 192  # payloads are padded to a multiple of this


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


# --- writing ---------------------------------------------------------------------------------


def _section(pid: int, table: int, extension: int, body: bytes) -> bytes:
    """A one-packet program table."""
    size = len(body) + 9
    section = bytes([table, 0xB0 | size >> 8, size & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


_TABLES = _section(PAT_PID, 0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])) + _section(
    PMT_PID, 2, 1, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0])
)


def _stamp(ticks: int) -> bytes:
    t = ticks & ((1 << 33) - 1)
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose elementary packets carry the payload, losslessly."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        body = payload[at : at + UNIT]
        pes = bytes([0, 0, 1, STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(k * TICKS) + body
        key = k % EVERY == 0
        clock = bytes([7, 0x50]) + (k * TICKS << 15 | 0x7E00).to_bytes(6, "big") if key else b""
        room = PACKET - 4 - len(clock)
        first = min(len(pes), room)
        middle, last = divmod(len(pes) - first, PACKET - 4)
        packets = np.empty((1 + middle + (last > 0), PACKET), dtype=np.uint8)
        n = len(packets)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter += n
        raw = np.frombuffer(pes, dtype=np.uint8)

        def short(row: np.ndarray, field: bytes, data: np.ndarray) -> None:
            """A packet with an adaptation field that fills what the data leaves."""
            fill = PACKET - 4 - len(data)
            row[3] |= 0x20
            field = (field or b"\0\0")[:fill].ljust(fill, b"\xff")
            row[4 : 4 + fill] = np.frombuffer(bytes([fill - 1]) + field[1:], dtype=np.uint8)
            row[4 + fill :] = data

        if key or first < room:
            short(packets[0], clock, raw[:first])
        else:
            packets[0, 4:] = raw[:first]
        if middle:
            packets[1 : 1 + middle, 4:] = raw[first : first + middle * (PACKET - 4)].reshape(middle, PACKET - 4)
        if last:
            short(packets[-1], b"", raw[len(raw) - last :])
        out.append(packets.tobytes())
    return b"".join(out)


# --- reading ---------------------------------------------------------------------------------


def _sections(payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections with a right checksum, gathered from the packets of one PID."""
    held = b""
    for start, data in payloads:
        if start and data:
            tail, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            done, held = held + tail, b""
            payload = data
        else:
            done, payload = held + data, b""
        for chunk in (done, payload):
            while len(chunk) >= 3 and chunk[0] != 0xFF and len(chunk) >= (size := 3 + ((chunk[1] & 0x0F) << 8 | chunk[2])):
                if crc32_mpeg(chunk[:size]) == 0:
                    yield chunk[:size]
                chunk = chunk[size:]
            held = chunk if chunk[:1] != b"\xff" else b""


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> dict:
    """Programs, streams and access units of a transport stream.

    ``payload``: the elementary bytes of all media streams by stream, then by order. ``units``: one
    (pid, pts, dts, random_access, offset, size) for each elementary packet. ``errors`` counts lost
    sync bytes, gaps of the continuity counters, flagged packets and elementary packets that
    are shorter than they say; a repeated packet is dropped and counted in ``repeated``.
    """
    whole = len(media) // PACKET * PACKET
    packets = np.frombuffer(media, dtype=np.uint8, count=whole).reshape(-1, PACKET)
    errors = {"sync": int((packets[:, 0] != SYNC).sum()) + (len(media) > whole), "flagged": 0, "gaps": 0, "short": 0}
    packets = packets[packets[:, 0] == SYNC]
    flagged = packets[:, 1] & 0x80 > 0
    errors["flagged"] = int(flagged.sum())
    packets = packets[~flagged]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts, control, counter = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 0x0F
    field = np.where(control & 2, packets[:, 4].astype(np.int64) + 1, 0)
    flags = np.where((control & 2 > 0) & (field > 1), packets[:, 5], 0)
    begin = np.where(control & 1, np.minimum(4 + field, PACKET), PACKET)
    column = np.arange(PACKET)
    repeated = 0

    def payload_of(rows: np.ndarray) -> np.ndarray:
        part = packets[rows]
        return part[column[None, :] >= begin[rows][:, None]]

    def tables(of: int, table: int) -> Iterator[bytes]:
        rows = np.flatnonzero(pid == of)
        yield from (s for s in _sections([(bool(starts[r]), packets[r, begin[r] :].tobytes()) for r in rows]) if s[0] == table)

    programs = {p: m for s in tables(PAT_PID, 0) for i in range(8, len(s) - 4, 4) for p, m in [(s[i] << 8 | s[i + 1], (s[i + 2] & 0x1F) << 8 | s[i + 3])] if p}
    streams: dict[int, int] = {}
    for at in programs.values():
        for s in tables(at, 2):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    units, chunks, offset = [], [], 0
    for of in streams:
        rows = np.flatnonzero((pid == of) & (control & 1 > 0))
        if len(rows) > 1:
            step = (counter[rows[1:]].astype(np.int16) - counter[rows[:-1]]) % 16
            same = step == 0
            repeated += int(same.sum())
            errors["gaps"] += int(((step > 1) & (flags[rows[1:]] & 0x80 == 0)).sum())
            rows = rows[np.concatenate([[True], ~same])]
        bounds = np.append(np.flatnonzero(starts[rows]), len(rows)) if len(rows) else np.empty(0, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            pes = payload_of(rows[a:b]).tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                errors["short"] += 1
                continue
            said, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            pts = _ticks(pes[9:14]) if pes[7] & 0x80 and head >= 14 else None
            dts = _ticks(pes[14:19]) if pes[7] & 0x40 and head >= 19 else pts
            errors["short"] += bool(said and said + 6 > len(pes))
            body = pes[head : said + 6 if said else None]
            units.append((of, pts, dts, bool(flags[rows[a]] & 0x40), offset, len(body)))
            chunks.append(body)
            offset += len(body)
    return {"programs": programs, "streams": streams, "units": units, "payload": b"".join(chunks), "errors": errors, "repeated": repeated, "packets": len(packets)}


def feature(found: dict) -> str:
    """A short text of what the stream holds; equal streams have equal texts."""
    stamps = [u[1] for u in found["units"] if u[1] is not None]
    return (
        f"programs={len(found['programs'])};streams={len(found['streams'])};packets={found['packets']};units={len(found['units'])};"
        f"random_access={sum(u[3] for u in found['units'])};first_pts={min(stamps, default=0)};last_pts={max(stamps, default=0)};"
        f"repeated={found['repeated']};" + ";".join(f"{k}={v}" for k, v in found["errors"].items())
    )


# --- columns ---------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of a text as UTF-8, and its bytes filled with blanks to a positive multiple of STEP."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // STEP)) * STEP, b" ")


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; a row weighs what its bytes do."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if weight > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def to_transport_streams(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text stored as a transport stream.

    One narrow pass without a shuffle; rows count one by one. A null text is an empty one, which
    is stored as one block of blanks. No rows give no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n, payload = padded(t.as_py())
                    yield i, n, mux(payload)

        yield from _batches(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,offset:bigint,size:bigint>>"


def parse_transport_streams(media: DataFrame, payload: bool = True) -> DataFrame:
    """The stored streams of ``doc_id, n_bytes, media`` read back, with timestamps and random-access points.

    Adds ``media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, feature, units``
    and, if asked for, ``payload``. A null stream is an empty one, without programs or units.
    """
    unit = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("units", pa.list_(unit))]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)
    names = [f.name for f in unit]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    stored = m.as_py() or b""
                    found = demux(stored)
                    back = found["payload"]
                    yield (
                        i, n, len(stored), hashlib.sha256(stored).hexdigest(), len(back), hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-16:]), feature(found), [dict(zip(names, u, strict=True)) for u in found["units"]],
                    ) + ((back,) if payload else ())

        yield from _batches(rows(), schema)

    ddl = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, units " + UNITS
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, ddl + ", payload binary" * payload)
