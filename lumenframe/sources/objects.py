"""Objects in memory: parsing, writing and locating element values.

A value is None (empty), a list of text, numbers or tags, bytes (bulk, little endian
whatever the file's order), a list of ``Item`` (sequence) or ``Fragments``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from lumenframe.functions import dictionary as dd
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import fail

ITEM, ITEM_END, SEQ_END, PIXELS = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010
UNDEFINED = 0xFFFFFFFF
LONG_HEADER = frozenset("OB OD OF OL OV OW SQ UC UR UT UN SV UV".split())
#: The reference's bulk locator reads SV and UV with a short header and loses its way; ``compat=True`` does so too.
LOCATOR_LONG_COMPAT = LONG_HEADER - {"SV", "UV"}
NUMBERS = {"SS": "h", "US": "H", "SL": "i", "UL": "I", "SV": "q", "UV": "Q", "FL": "f", "FD": "d"}
WIDTH = {"OW": 2, "OL": 4, "OF": 4, "OV": 8, "OD": 8}
IMPLEMENTATION_UID = "2.25.298745112098734509871245098712450987"


@dataclass
class Fragments:
    """Encapsulated pixel data: basic offset table and fragments."""

    offsets: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)


@dataclass
class Element:
    tag: int
    vr: str
    value: object = None
    offset: int | None = None  # place of the value in the source, from the start of the file
    length: int | None = None

    @property
    def vm(self) -> int:
        v = self.value
        if v is None:
            return 0
        return 1 if isinstance(v, bytes | Fragments) else len(v)


Item = dict  # tag -> Element


@dataclass
class Object:
    meta: dict[int, Element] = field(default_factory=dict)
    data: dict[int, Element] = field(default_factory=dict)

    @property
    def syntax(self) -> str:
        e = self.meta.get(0x00020010)
        return ts.normalize(e.value[0]) if e and e.value else ts.EXPLICIT_LE

    def get(self, tag: int) -> Element | None:
        return (self.meta if tag >> 16 == 2 else self.data).get(tag)

    def text(self, tag: int) -> str | None:
        e = self.get(tag)
        if e is None or e.value is None or isinstance(e.value, bytes | Fragments) or e.vr == "SQ":
            return None
        return "\\".join(x if isinstance(x, str) else dd.expression(x) if e.vr == "AT" else number_text(x) for x in e.value)

    def elements(self) -> Iterator[Element]:
        yield from (self.meta[t] for t in sorted(self.meta))
        yield from (self.data[t] for t in sorted(self.data))


def number_text(x: int | float) -> str:
    """Shortest text of a number; whole floats without a fraction."""
    return str(int(x)) if isinstance(x, float) and x.is_integer() and abs(x) < 1e16 else repr(x) if isinstance(x, float) else str(x)


def decode_value(vr: str, raw: bytes, order: str) -> object:
    """A value from its bytes."""
    if not raw:
        return None
    if vr in dd.STRING_VRS:
        text = raw.decode("utf-8", "replace")
        text = text.rstrip("\0") if vr == "UI" else text.rstrip(" \0")
        return [x.strip(" ") if vr not in ("UC", "PN", "LO", "SH") else x.rstrip(" ") for x in text.split("\\")] if text else None
    if vr in dd.TEXT_VRS:
        text = raw.decode("utf-8", "replace").rstrip(" \0")
        return [text] if text else None
    if vr == "AT":
        n = len(raw) // 4
        v = struct.unpack(f"{order}{2 * n}H", raw[: 4 * n])
        return [v[2 * k] << 16 | v[2 * k + 1] for k in range(n)]
    if vr in NUMBERS:
        f = NUMBERS[vr]
        n = len(raw) // struct.calcsize("=" + f)
        return list(struct.unpack(f"{order}{n}{f}", raw[: n * struct.calcsize("=" + f)]))
    return swap(raw, WIDTH.get(vr, 1)) if order == ">" else raw


def swap(raw: bytes, width: int) -> bytes:
    if width == 1:
        return raw
    if len(raw) % width:
        raise fail("InvalidBulkDataLength", f"length {len(raw)} is not a multiple of {width}")
    return np.frombuffer(raw, f">u{width}").astype(f"<u{width}").tobytes()


def encode_value(e: Element, order: str) -> bytes:
    """Bytes of a value, padded to an even length."""
    v = e.value
    if v is None:
        return b""
    if isinstance(v, bytes):
        raw = v
        if order == ">":
            raw = swap(raw, WIDTH.get(e.vr, 1))
        return raw + b"\0" * (len(raw) % 2)
    if e.vr in dd.STRING_VRS or e.vr in dd.TEXT_VRS or all(isinstance(x, str) for x in v) and e.vr not in NUMBERS and e.vr != "AT":
        raw = "\\".join(x if isinstance(x, str) else number_text(x) for x in v).encode()
        return raw + (b"\0" if e.vr == "UI" else b" ") * (len(raw) % 2)
    if e.vr == "AT":
        return b"".join(struct.pack(order + "HH", int(x) >> 16, int(x) & 0xFFFF) for x in v)
    f = NUMBERS[e.vr]
    try:
        return struct.pack(f"{order}{len(v)}{f}", *[(float(x) if f in "fd" else int(x)) for x in v])
    except (struct.error, ValueError, OverflowError) as err:
        raise fail("InvalidValue", f"{dd.expression(e.tag)} {e.vr}: {err}") from None


class Reader:
    """A cursor over one dataset."""

    def __init__(self, data: bytes, explicit: bool, order: str, base: int = 0, only: frozenset[int] | None = None):
        self.data, self.explicit, self.order, self.base, self.only = data, explicit, order, base, only

    def tag(self, at: int) -> int:
        if at + 4 > len(self.data):
            raise fail("Truncated", "element header beyond the end")
        g, e = struct.unpack_from(self.order + "HH", self.data, at)
        return g << 16 | e

    def header(self, at: int) -> tuple[int, str, int, int]:
        """Tag, representation, length and place of the value."""
        d, t = self.data, self.tag(at)
        try:
            if t >> 16 == 0xFFFE or not self.explicit:
                n = struct.unpack_from(self.order + "I", d, at + 4)[0]
                vr = "" if t >> 16 == 0xFFFE else dd.vr_of(t)
                return t, vr, n, at + 8
            vr = d[at + 4 : at + 6].decode("latin-1")
            if vr not in dd.ALL_VRS:
                vr = "UN"
            if vr in LONG_HEADER:
                return t, vr, struct.unpack_from(self.order + "I", d, at + 8)[0], at + 12
            return t, vr, struct.unpack_from(self.order + "H", d, at + 6)[0], at + 8
        except struct.error:
            raise fail("Truncated", "element header beyond the end") from None

    def dataset(self, at: int, end: int | None) -> tuple[dict[int, Element], int]:
        """Elements up to ``end``, or to the item's delimiter."""
        out: dict[int, Element] = {}
        stop = len(self.data) if end is None else end
        while at < stop:
            t, vr, n, v = self.header(at)
            if t == ITEM_END:
                return out, v
            if t == SEQ_END:
                return out, at
            e, at = self.element(t, vr, n, v)
            out[t] = e
        if at > stop:
            raise fail("Truncated", "an element reaches beyond its item")
        return out, at

    def element(self, t: int, vr: str, n: int, v: int) -> tuple[Element, int]:
        if n == UNDEFINED and (t == PIXELS or vr in ("OB", "OW")):
            frag, at = self.fragments(v)
            return Element(t, "OB", frag, self.base + v, at - 8 - v), at
        if vr == "SQ" or n == UNDEFINED:
            inner = self if vr == "SQ" else Reader(self.data, False, "<", self.base, self.only)  # undefined UN is implicit
            items, at = inner.items(v, n)
            return Element(t, "SQ", items, self.base + v, at - v - (8 if n == UNDEFINED else 0)), at
        if v + n > len(self.data):
            raise fail("Truncated", f"value of {dd.expression(t)} reaches beyond the end")
        if self.only is not None and t not in self.only:
            return Element(t, vr, None, self.base + v, n), v + n
        return Element(t, vr, decode_value(vr, self.data[v : v + n], self.order), self.base + v, n), v + n

    def items(self, at: int, n: int) -> tuple[list[dict[int, Element]] | None, int]:
        out: list[dict[int, Element]] = []
        end = len(self.data) if n == UNDEFINED else at + n
        while at < end:
            t, _, size, v = self.header(at)
            if t == SEQ_END:
                return out, v
            if t != ITEM:
                raise fail("InvalidSequence", f"{dd.expression(t)} where an item should stand")
            item, at = self.dataset(v, None if size == UNDEFINED else v + size)
            out.append(item)
        if n == UNDEFINED:
            raise fail("Truncated", "sequence without a delimiter")
        return out, at

    def fragments(self, at: int) -> tuple[Fragments, int]:
        parts = []
        while True:
            t, _, n, v = self.header(at)
            if t == SEQ_END:
                break
            if t != ITEM or v + n > len(self.data):
                raise fail("InvalidPixelSequence", "bad item in pixel data")
            parts.append(self.data[v : v + n])
            at = v + n
        return fragments_of(parts), v


def fragments_of(parts: list[bytes]) -> Fragments:
    table = parts[0] if parts else b""
    if len(table) % 4:
        raise fail("InvalidPixelSequence", "offset table length is not a multiple of 4")
    return Fragments(list(struct.unpack(f"<{len(table) // 4}I", table)), parts[1:])


def has_preamble(content: bytes) -> bool:
    return len(content) >= 132 and content[128:132] == b"DICM"


def parse(content: bytes, preamble: str = "auto", only: frozenset[int] | None = None) -> Object:
    """Reads a file. ``preamble="always"`` refuses one without the 128-byte preamble.

    With ``only``, elements of other tags keep place and length but no value, so pixels that
    nobody asked for are neither copied nor decoded; sequences are read for what is in them.
    """
    if has_preamble(content):
        at = 132
    elif preamble == "always":
        raise fail("NoPreamble", "the 128-byte preamble and magic code are missing")
    else:
        at = 4 if content[:4] == b"DICM" else 0
    r, meta = Reader(content, True, "<"), {}
    while at + 8 <= len(content) and struct.unpack_from("<H", content, at)[0] == 2:
        t, vr, n, v = r.header(at)
        meta[t], at = r.element(t, vr, n, v)
    if not meta:
        raise fail("NoMeta", "no file meta information")
    o = Object(meta)
    uid = o.syntax
    body, base = content, 0
    if uid == ts.DEFLATED:
        try:
            body, base, at = zlib.decompressobj(-15).decompress(content[at:]), 0, 0
        except zlib.error as err:
            raise fail("Deflate", str(err)) from None
    o.data, _ = Reader(body, uid != ts.IMPLICIT_LE, ts.byte_order(uid), base, only).dataset(at, None)
    return o


class Writer:
    def __init__(self, explicit: bool, order: str):
        self.explicit, self.order, self.out = explicit, order, []

    def head(self, tag: int, vr: str, n: int) -> None:
        o = self.order
        h = struct.pack(o + "HH", tag >> 16, tag & 0xFFFF)
        if not self.explicit or tag >> 16 == 0xFFFE:
            h += struct.pack(o + "I", n)
        elif vr in LONG_HEADER:
            h += vr.encode() + b"\0\0" + struct.pack(o + "I", n)
        else:
            if n > 0xFFFF:
                raise fail("ValueTooLong", f"{dd.expression(tag)} {vr} holds {n} bytes")
            h += vr.encode() + struct.pack(o + "H", n)
        self.out.append(h)

    def dataset(self, data: dict[int, Element]) -> None:
        for t in sorted(data):
            e = data[t]
            if isinstance(e.value, Fragments):
                self.head(t, "OB", UNDEFINED)
                self.out.append(fragment_bytes(e.value, self.order))
            elif e.vr == "SQ":
                self.head(t, "SQ", UNDEFINED)
                for item in e.value or ():
                    self.head(ITEM, "", UNDEFINED)
                    self.dataset(item)
                    self.head(ITEM_END, "", 0)
                self.head(SEQ_END, "", 0)
            else:
                raw = encode_value(e, self.order)
                self.head(t, e.vr, len(raw))
                self.out.append(raw)


def fragment_bytes(f: Fragments, order: str = "<") -> bytes:
    """Items of the offset table and fragments, and the sequence delimiter."""
    out = []
    for part in (struct.pack(f"<{len(f.offsets)}I", *f.offsets), *f.parts):
        part += b"\0" * (len(part) % 2)
        out += [struct.pack(order + "HHI", 0xFFFE, 0xE000, len(part)), part]
    return b"".join(out) + struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0)


def with_meta(o: Object, uid: str) -> dict[int, Element]:
    """File meta for a transfer syntax; class and instance follow the dataset."""
    meta = {t: e for t, e in o.meta.items() if t != 0x00020000}
    meta.setdefault(0x00020001, Element(0x00020001, "OB", b"\0\1"))
    for t, src in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        e = o.data.get(src)
        if t not in meta or meta[t].value is None:
            meta[t] = Element(t, "UI", [e.value[0]] if e and e.value else None)
    meta[0x00020010] = Element(0x00020010, "UI", [uid])
    meta.setdefault(0x00020012, Element(0x00020012, "UI", [IMPLEMENTATION_UID]))
    return meta


def write(o: Object, uid: str | None = None) -> bytes:
    """A file with preamble and meta information. Pixel data is written as it is."""
    uid = ts.normalize(uid or o.syntax)
    head = Writer(True, "<")
    head.dataset(with_meta(o, uid))
    body = b"".join(head.out)
    head = Writer(True, "<")
    head.dataset({0x00020000: Element(0x00020000, "UL", [len(body)])})
    w = Writer(uid != ts.IMPLICIT_LE, ts.byte_order(uid))
    w.dataset({t: e for t, e in o.data.items() if t & 0xFFFF or t >> 16 == 2})
    data = b"".join(w.out)
    if uid == ts.DEFLATED:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = z.compress(data) + z.flush()
        data += b"\0" * (len(data) % 2)
    return b"\0" * 128 + b"DICM" + b"".join(head.out) + body + data


def build(values: dict[str | int, object], syntax: str = ts.EXPLICIT_LE, vrs: dict[str | int, str] | None = None) -> Object:
    """An object from keywords or tags and plain values."""
    o = Object({0x00020010: Element(0x00020010, "UI", [syntax])})
    for k, v in values.items():
        t = k if isinstance(k, int) else dd.BY_KEYWORD[k]
        vr = (vrs or {}).get(k) or dd.vr_of(t)
        if v is not None and not isinstance(v, list | bytes | Fragments):
            v = [v]
        (o.meta if t >> 16 == 2 else o.data)[t] = Element(t, vr, v)
    return o


class _Locator:
    def __init__(self, data: bytes, explicit: bool, order: str, long: frozenset = LONG_HEADER):
        self.d, self.explicit, self.order, self.long = data, explicit, order, long

    def header(self, at: int) -> tuple[int, str, int | None, int]:
        d, o = self.d, self.order
        try:
            g, e = struct.unpack_from(o + "HH", d, at)
            t = g << 16 | e
            if g == 0xFFFE or not self.explicit:
                n, v, vr = struct.unpack_from(o + "I", d, at + 4)[0], at + 8, "UN"
            else:
                vr = d[at + 4 : at + 6].decode("latin-1")
                vr = vr if vr in dd.ALL_VRS else "UN"
                n, v = (struct.unpack_from(o + "I", d, at + 8)[0], at + 12) if vr in self.long else (struct.unpack_from(o + "H", d, at + 6)[0], at + 8)
        except struct.error:
            raise fail("BulkDataOutOfRange", "element header beyond the end") from None
        return t, vr, None if n == UNDEFINED else n, v

    def skip(self, at: int) -> int:
        """Place of the delimiter that ends an undefined length."""
        while at < len(self.d):
            t, _, n, v = self.header(at)
            if t in (SEQ_END, ITEM_END):
                return at
            at = self.skip(v) + 8 if n is None else v + n
        raise fail("BulkDataOutOfRange", "undefined length without a delimiter")


def locate(content: bytes, compat: bool = False) -> dict[int, tuple[int, int]]:
    """Place and length of every root element's value, in one pass over the headers.

    Lengths leave out the delimiter of an undefined length.
    """
    out: dict[int, tuple[int, int]] = {}
    at, uid = 132 if has_preamble(content) else 0, None
    w = _Locator(content, True, "<")
    while at + 8 <= len(content) and struct.unpack_from("<H", content, at)[0] == 2:
        t, _, n, v = w.header(at)
        if n is None:
            raise fail("BulkDataOutOfRange", "undefined length in file meta information")
        if t == 0x00020010:
            uid = content[v : v + n].decode("utf-8", "replace").strip("\0").rstrip()
        out[t] = v, n
        at = v + n
    w = _Locator(content, *ts.dataset_encoding(uid or ts.EXPLICIT_LE), LOCATOR_LONG_COMPAT if compat else LONG_HEADER)
    while at < len(content):
        t, _, n, v = w.header(at)
        end = w.skip(v) if n is None else v + n
        out.setdefault(t, (v, end - v))
        at = end + 8 if n is None else end
    return out
