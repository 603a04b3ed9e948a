"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``parse`` reads a stream: program association and map tables with their CRC, continuity
counters per packet identifier, reassembled packetised elementary stream (PES) packets,
time stamps and random-access points.  ``mux`` writes one.  ``streams`` and ``index``
apply the parser to a binary column, map-only, and return rows of elementary packets.

Defined cases: null content gives no rows (``index``) or a null feature row
(``streams``); bytes before a sync point and broken packets are counted, not fatal; a
repeated packet is dropped once; a jump of a counter without the discontinuity flag is
counted and ends the packet that was being assembled, whose rest is marked incomplete.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import runs

SIZE, SYNC = 188, 0x47
PMT_PID, MEDIA_PID = 0x1000, 0x0100
UNIT = 16_384  # payload bytes of an elementary packet that mux writes
TICKS = 3_600  # 90 kHz ticks between them
PRIVATE = 0x06


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        t = np.where(t & 0x80000000, (t << 1) ^ 0x04C11DB7, t << 1).astype(np.uint32)
    return t


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(SIZE, b"\xff")


_PAT = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))
_TABLES = np.frombuffer(_PAT + _PMT, np.uint8).reshape(2, SIZE)


def _stamp(t: int, mark: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """One program with one private stream: tables, then an elementary packet for each ``unit`` bytes.

    Every elementary packet has a time stamp and starts at a random-access point with a
    clock reference; its length is unbounded (0) only if it doesn't fit 16 bits.
    """
    out, counter = [_TABLES.tobytes()], 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        part = payload[at : at + unit]
        pts = (k * TICKS) & 0x1FFFFFFFF
        size = len(part) + 8
        pes = b"\x00\x00\x01\xbd" + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts, 2) + part
        pcr = (pts >> 1).to_bytes(4, "big") + bytes([(pts & 1) << 7 | 0x7E, 0])
        first = b"\x50" + pcr  # random access, clock reference
        room = SIZE - 4 - 1 - len(first)
        head = pes[:room]
        pad = room - len(head)
        a = bytes([len(first) + pad]) + first + b"\xff" * pad
        out.append(bytes([SYNC]) + (0x4000 | MEDIA_PID).to_bytes(2, "big") + bytes([0x30 | counter]) + a + head)
        counter = (counter + 1) & 15
        rest = pes[room:]
        full, tail = divmod(len(rest), SIZE - 4)
        if full:
            block = np.empty((full, SIZE), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
            block[:, 3] = 0x10 | ((counter + np.arange(full)) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (SIZE - 4)).reshape(full, SIZE - 4)
            out.append(block.tobytes())
            counter = (counter + full) & 15
        if tail:
            pad = SIZE - 4 - tail - 1
            a = bytes([pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"")
            out.append(bytes([SYNC]) + MEDIA_PID.to_bytes(2, "big") + bytes([0x30 | counter]) + a + rest[full * (SIZE - 4) :])
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Packet:
    """An elementary packet: where it starts, its stamps, and its payload."""

    pid: int
    offset: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    complete: bool
    payload: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program: identifier of its map table
    types: dict[int, int] = field(default_factory=dict)  # identifier: stream type
    clock: dict[int, int] = field(default_factory=dict)  # program: identifier with its clock
    packets: list[Packet] = field(default_factory=list)
    n_packets: int = 0
    skipped_bytes: int = 0
    errors: int = 0  # transport errors, bad tables and broken headers
    discontinuities: int = 0
    duplicates: int = 0
    scrambled: int = 0


def _synced(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of packets, and bytes outside them."""
    n = len(data)
    if n and n % SIZE == 0 and (data[::SIZE] == SYNC).all():
        return np.arange(0, n, SIZE), 0
    at, out = 0, []
    while at + SIZE <= n:
        if data[at] == SYNC and (at + SIZE == n or data[at + SIZE] == SYNC or at + 2 * SIZE > n):
            out.append(at)
            at += SIZE
        else:
            nxt = np.flatnonzero(data[at + 1 :] == SYNC)
            if not len(nxt):
                break
            at += 1 + int(nxt[0])
    return np.array(out, np.int64), n - SIZE * len(out)


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse(content: bytes) -> Stream:
    s = Stream()
    data = np.frombuffer(content, np.uint8)
    at, s.skipped_bytes = _synced(data)
    s.n_packets = len(at)
    if not len(at):
        return s
    whole = s.skipped_bytes == 0
    rows = data.reshape(-1, SIZE) if whole else data[at[:, None] + np.arange(SIZE)]
    b1, b3 = rows[:, 1], rows[:, 3]
    pid = (b1.astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    bad, start = (b1 & 0x80) != 0, (b1 & 0x40) != 0
    scram, ctl, cc = b3 >> 6, b3 >> 4 & 3, b3 & 15
    adapt = np.where(ctl >= 2, rows[:, 4].astype(np.int32), -1)
    flags = np.where(adapt > 0, rows[:, 5], 0)
    body = np.where(ctl >= 2, 5 + adapt, 4)
    broken = (ctl == 0) | (body > SIZE)
    s.errors += int((bad | broken).sum())
    good = ~bad & ~broken & (pid != 0x1FFF)
    s.scrambled = int((good & (scram != 0)).sum())
    # tables first: the map tables' identifiers come from the association table
    pmt = _tables(s, rows, at, pid, good, start, ctl, body, 0, True)
    for program, p in sorted(pmt.items()):
        _tables(s, rows, at, pid, good, start, ctl, body, p, False, program)
    for p in sorted(s.types):
        _elementary(s, rows, at, p, np.flatnonzero(good & (pid == p)), start, scram, ctl, cc, flags, body)
    s.packets.sort(key=lambda x: x.offset)
    return s


def _tables(s: Stream, rows, at, pid, good, start, ctl, body, want: int, pat: bool, program: int = 0) -> dict[int, int]:
    buf = b""
    for i in np.flatnonzero(good & (pid == want) & ((ctl & 1) == 1)).tolist():
        part = rows[i, body[i] :].tobytes()
        if start[i]:
            skip = part[0] if part else 0
            done, part = part[1 : 1 + skip], part[1 + skip :]
            _section_read(s, buf + done, pat, program)
            buf = part
        else:
            buf += part
        buf = _section_read(s, buf, pat, program)
    return dict(s.programs) if pat else {}


def _section_read(s: Stream, buf: bytes, pat: bool, program: int) -> bytes:
    """Takes whole sections off the front."""
    while len(buf) >= 3 and buf[0] != 0xFF:
        n = 3 + ((buf[1] & 0x0F) << 8 | buf[2])
        if len(buf) < n:
            return buf
        sec, buf = buf[:n], buf[n:]
        if sec[0] != (0 if pat else 2) or n < 12:
            continue
        if crc32_mpeg(sec) != 0:
            s.errors += 1
            continue
        if not sec[5] & 1:
            continue  # not current yet
        if pat:
            for k in range(8, n - 4, 4):
                num, p = int.from_bytes(sec[k : k + 2], "big"), int.from_bytes(sec[k + 2 : k + 4], "big") & 0x1FFF
                if num:
                    s.programs[num] = p
        else:
            s.clock[program] = int.from_bytes(sec[8:10], "big") & 0x1FFF
            k = 12 + (int.from_bytes(sec[10:12], "big") & 0x0FFF)
            while k + 5 <= n - 4:
                s.types[int.from_bytes(sec[k + 1 : k + 3], "big") & 0x1FFF] = sec[k]
                k += 5 + (int.from_bytes(sec[k + 3 : k + 5], "big") & 0x0FFF)
    return b"" if buf[:1] == b"\xff" else buf


def _elementary(s: Stream, rows, at, p, idx, start, scram, ctl, cc, flags, body) -> None:
    has = (ctl[idx] & 1) == 1
    c = cc[idx].astype(np.int16)
    jump = (flags[idx] & 0x80) != 0
    gap = np.zeros(len(idx), bool)
    drop = np.zeros(len(idx), bool)
    if len(idx) > 1:
        step = (c[1:] - c[:-1]) & 15
        want = has[1:].astype(np.int16)
        same = (step == 0) & has[1:] & has[:-1] & ~jump[1:]
        if same.any():
            equal = np.zeros(len(same), bool)
            k = np.flatnonzero(same)
            equal[k] = (rows[idx[k + 1], 4:] == rows[idx[k], 4:]).all(1)
            drop[1:] = equal
            drop[1:] &= ~np.concatenate([[False], drop[1:-1]])
        gap[1:] = (step != want) & ~jump[1:] & ~drop[1:]
    s.duplicates += int(drop.sum())
    s.discontinuities += int(gap.sum())
    use = has & ~drop & (scram[idx] == 0)
    idx, gap = idx[use], gap[use]
    begin = np.flatnonzero(start[idx])
    for a, b in zip(begin, np.append(begin[1:], len(idx)), strict=True):
        torn = np.flatnonzero(gap[a + 1 : b])
        end = a + 1 + int(torn[0]) if len(torn) else b
        k = idx[a:end]
        plain = k[1:][body[k[1:]] == 4]
        if len(plain) == len(k) - 1:
            pes = rows[k[0], body[k[0]] :].tobytes() + rows[k[1:], 4:].tobytes()
        elif len(plain) == len(k) - 2 and body[k[-1]] != 4:
            pes = rows[k[0], body[k[0]] :].tobytes() + rows[k[1:-1], 4:].tobytes() + rows[k[-1], body[k[-1]] :].tobytes()
        else:
            pes = b"".join(rows[i, body[i] :].tobytes() for i in k)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 6:
            s.errors += 1
            continue
        sid, size = pes[3], int.from_bytes(pes[4:6], "big")
        pts = dts = None
        lead = 6
        if sid not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(pes) >= 9:
            lead = 9 + pes[8]
            if pes[7] & 0x80 and len(pes) >= 14:
                pts = dts = _time(pes[9:14])
            if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19:
                dts = _time(pes[14:19])
        body_bytes = pes[lead : 6 + size] if size else pes[lead:]
        whole = not len(torn) and (not size or len(pes) >= 6 + size)
        s.packets.append(Packet(p, int(at[k[0]]), sid, pts, dts, bool(flags[k[0]] & 0x40), whole, body_bytes))


def feature(s: Stream) -> str:
    """Programs, streams, stamps and random-access points in one line."""
    known = [x.pts for x in s.packets if x.pts is not None]
    points = [x.offset for x in s.packets if x.random_access]
    digest = zlib.crc32(",".join(map(str, points)).encode())
    return f"programs={len(s.programs)} streams={','.join(f'{p}:{t}' for p, t in sorted(s.types.items()))} ts={s.n_packets} pes={len(s.packets)} pts={min(known, default=-1)}..{max(known, default=-1)} rap={len(points)}:{digest:08x} cc_errors={s.discontinuities} errors={s.errors}"


def index(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row per elementary packet: ``keep``, then pid, stream_type, offset, pts, dts, random_access, complete, payload."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema)
    names = ["pid", "stream_type", "offset", "pts", "dts", "random_access", "complete", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                x = b.column(len(keep))[r].as_py()
                if x is None:
                    continue
                s = parse(x)
                n = len(s.packets)
                cols = [[q.pid for q in s.packets], [s.types[q.pid] for q in s.packets], [q.offset for q in s.packets], [q.pts for q in s.packets], [q.dts for q in s.packets], [q.random_access for q in s.packets], [q.complete for q in s.packets], [q.payload for q in s.packets]]
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(k)[r], n) for k in range(len(keep))] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keep, *names])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{content}`").cast("binary").alias("__content")).mapInArrow(work, kinds + "pid int, stream_type int, offset bigint, pts bigint, dts bigint, random_access boolean, complete boolean, payload binary")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a transport stream, reads it back and returns digests, features, stamps and random-access points.

    A null text is empty; rows that repeat a text get equal values; a text of any length is one
    stream; an empty table gives no rows.  pts, dts: of each elementary packet, null where it has none.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pts array<bigint>, dts array<bigint>, random_access_offsets array<bigint>"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = b.column(1).cast(pa.large_binary())
            for i, j in runs(b.column(1)):
                out = []
                for x in t.slice(i, j - i):
                    raw = x.as_py() or b""
                    media = mux(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                    s = parse(media)
                    back = b"".join(q.payload for q in s.packets)
                    out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [q.pts for q in s.packets], [q.dts for q in s.packets], [q.offset for q in s.packets if q.random_access]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i)] + [pa.array(c, pa.list_(pa.int64()) if isinstance(c[0], list) else pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return common.documents(spark, sf_dir).select("doc_id", "text").mapInArrow(work, schema)
