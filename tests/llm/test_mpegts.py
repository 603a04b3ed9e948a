import random

from lumenframe.llm import mpegts as m


def naive_payload(ts):
    """Media payload by an independent packet loop."""
    out, pes = [], b""
    for at in range(0, len(ts), 188):
        p = ts[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 0x1F) << 8 | p[2] != m.MEDIA_PID:
            continue
        body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40:
            out.append(pes)
            pes = b""
        pes += body
    out.append(pes)
    return b"".join(x[9 + x[8] :] for x in out if x)


def test_round_trip():
    r = random.Random(3)
    for n in (0, 1, 64, 150, 183, 184, 185, 16383, 16384, 16385, 70_001):
        data = r.randbytes(n)
        ts = m.mux(data)
        s = m.parse(ts)
        assert b"".join(p.payload for p in s.packets) == data == naive_payload(ts)
        assert (s.programs, s.types, s.discontinuities, s.errors, s.duplicates, s.skipped_bytes) == ({1: m.PMT_PID}, {m.MEDIA_PID: m.PRIVATE}, 0, 0, 0, 0)
        assert [p.pts for p in s.packets] == [k * m.TICKS for k in range(len(s.packets))] and all(p.random_access and p.complete for p in s.packets)


def test_damage():
    ts = m.mux(bytes(range(256)) * 200)
    packets = [ts[k : k + 188] for k in range(0, len(ts), 188)]
    lost = m.parse(b"".join(packets[:10] + packets[11:]))
    assert lost.discontinuities == 1 and [p.complete for p in lost.packets][0] is False
    twice = m.parse(b"".join(packets[:10] + packets[9:]))
    assert twice.duplicates == 1 and twice.discontinuities == 0 and b"".join(p.payload for p in twice.packets) == bytes(range(256)) * 200
    shifted = m.parse(b"junk!" + ts)
    assert shifted.skipped_bytes == 5 and len(shifted.packets) == len(m.parse(ts).packets)
    bad = bytearray(packets[0])
    bad[20] ^= 0
    bad[8] ^= 1
    broken = m.parse(bytes(bad) + b"".join(packets[1:]))
    assert broken.errors == 1 and not broken.programs and not broken.packets
    assert m.parse(b"").n_packets == 0 and m.parse(b"\x47" * 100).n_packets == 0


def test_index(spark):
    df = spark.createDataFrame([(1, bytearray(m.mux(b"x" * 20_000)), "k"), (2, None, None)], "doc_id bigint, content binary, pid string")
    rows = m.index(df.select("doc_id", "content"), "content", ["doc_id"]).orderBy("offset").collect()
    assert [(r.doc_id, r.pts, len(r.payload)) for r in rows] == [(1, 0, 16384), (1, 3600, 3616)]
