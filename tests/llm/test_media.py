import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import media
from corpusloom.llm.queries import op4_media


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30_000), st.integers(0, 255))
def test_round_trip(n, salt):
    payload = media.padded(bytes((i * 7 + salt) % 128 for i in range(n)).decode())[1]
    stored = media.mux(payload)
    found = media.demux(stored)
    assert len(stored) % media.PACKET == 0 and found["payload"] == payload
    assert not any(found["errors"].values()) and not found["repeated"]
    assert [u[1] for u in found["units"]] == [k * media.TICKS for k in range(len(found["units"]))]
    assert [u[3] for u in found["units"]] == [k % media.EVERY == 0 for k in range(len(found["units"]))]


def test_faults_are_counted():
    stored = media.mux(b"x" * 19_200)
    packets = [stored[i : i + media.PACKET] for i in range(0, len(stored), media.PACKET)]
    lost = media.demux(b"".join(packets[:10] + packets[11:]))
    assert lost["errors"]["gaps"] == 1 and lost["errors"]["short"] == 1
    twice = media.demux(b"".join(packets[:10] + packets[9:]))
    assert twice["repeated"] == 1 and twice["payload"] == b"x" * 19_200
    broken = media.demux(b"".join(packets[:5] + [b"\0" + packets[5][1:]] + packets[6:]))
    assert broken["errors"]["sync"] == 1 and broken["errors"]["gaps"] == 1
    flagged = media.demux(b"".join(packets[:5] + [packets[5][:1] + bytes([packets[5][1] | 0x80]) + packets[5][2:]] + packets[6:]))
    assert flagged["errors"]["flagged"] == 1
    no_table = media.demux(b"".join(packets[1:]))
    assert not no_table["programs"] and not no_table["units"]
    assert media.demux(b"")["units"] == []


def test_checksum_of_tables():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def expected(text):
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))


def test_query_on_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, payload = expected(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.mux(payload)).hexdigest() and r["feature"]


def test_odd_rows(odd_docs, no_docs):
    rows = media.parse_transport_streams(media.to_transport_streams(odd_docs)).collect()
    assert len(rows) == 10
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        assert bytes(r["payload"]) == expected(texts[r["doc_id"]])[1]
    assert media.parse_transport_streams(media.to_transport_streams(no_docs)).count() == 0


def plain_reader(stored):
    """Payload, timestamps and random-access points of the one program, read with nothing of the module."""
    pmt = pid = None
    data, stamps, points = b"", [], []
    for at in range(0, len(stored), 188):
        p = stored[at : at + 188]
        assert p[0] == 0x47
        number, start, control = (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40, p[3] >> 4 & 3
        body, random_access = p[4:], False
        if control & 2:
            random_access = body[0] > 0 and bool(body[1] & 0x40)
            body = body[1 + body[0] :]
        if number == 0:
            pmt = (body[1 + 10] & 0x1F) << 8 | body[1 + 11]
        elif number == pmt:
            pid = (body[1 + 13] & 0x1F) << 8 | body[1 + 14]
        elif number == pid and control & 1:
            if start:
                assert body[:3] == b"\0\0\1"
                t = body[9:14]
                stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
                points.append(random_access)
                body = body[9 + body[8] :]
            data += body
    return data, stamps, points


def test_an_independent_reader_reads_the_same():
    for n in (0, 1, 191, 192, 3072, 3073, 40_000):
        payload = media.padded("x" * n)[1]
        stored = media.mux(payload)
        data, stamps, points = plain_reader(stored)
        units = media.demux(stored)["units"]
        assert data == payload and stamps == [u[1] for u in units] and points == [u[3] for u in units]
