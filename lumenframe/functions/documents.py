"""Flat and standard JSON documents of objects, with inline or addressed bulk data."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import struct

import numpy as np

from lumenframe.functions import dictionary as dd
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import ObjectError, fail
from lumenframe.sources import objects as ob
from lumenframe.sources.objects import Element, Fragments, Object

INLINE = 32  # bulk values up to this many bytes stay inline in uri mode
_JSON_INT = {"SS": (-(1 << 15), 1 << 15), "US": (0, 1 << 16), "SL": (-(1 << 31), 1 << 31), "UL": (0, 1 << 32), "SV": (-(1 << 63), 1 << 63), "UV": (0, 1 << 64)}
_META = frozenset(0x00020000 | x for x in (0x01, 0x02, 0x03, 0x10, 0x12, 0x13, 0x16, 0x17, 0x18, 0x100, 0x102))


class Source:
    """A file's bytes and the places of its root elements, found once."""

    def __init__(self, content: bytes, compat: bool = False):
        self.content, self.compat, self._places = content, compat, None

    def place(self, tag: int) -> tuple[int, int] | None:
        if self._places is None:
            self._places = ob.locate(self.content, self.compat)
        return self._places.get(tag)

    def slice(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > len(self.content):
            raise fail("BulkDataOutOfRange", f"offset {offset} and length {length} reach beyond the source")
        return self.content[offset : offset + length]


def raw_bytes(e: Element) -> bytes:
    """A bulk value's bytes as they would be inlined."""
    if isinstance(e.value, Fragments):
        return ob.fragment_bytes(e.value)
    if e.value is None:
        return b""
    if isinstance(e.value, bytes):
        return e.value
    raise fail("UnsupportedBulkDataVr", f"{e.vr} has no bulk bytes")


def bulk_uri(base: str | None, offset: int, length: int) -> str:
    return f"{base or ''}?offset={offset}&length={length}"


def parse_bulk_uri(uri: str) -> tuple[int, int]:
    """Offset and length; of repeated parameters the last counts, also if it isn't a number."""
    query = uri.split("?", 1)[1] if "?" in uri else uri
    got: dict[str, int | None] = {"offset": None, "length": None}
    for part in query.split("&"):
        k, eq, v = part.partition("=")
        if eq and k in got:
            got[k] = int(v) if re.fullmatch(r"\+?[0-9]+", v) else None
    if got["offset"] is None or got["length"] is None:
        raise fail("InvalidBulkDataUri", f"no offset and length in {uri!r}")
    return got["offset"], got["length"]


def bulk_json(e: Element, mode: str, source: Source | None, base: str | None) -> dict:
    if mode == "uri" and source is not None:
        at = source.place(e.tag)
        if at is None:
            raise fail("BulkDataNotFound", f"{dd.expression(e.tag)} is not in the source")
        if at[1] > INLINE:
            return {"BulkDataURI": bulk_uri(base, *at)}
        return {"InlineBinary": base64.b64encode(source.slice(*at)).decode()}
    return {"InlineBinary": base64.b64encode(raw_bytes(e)).decode()}


def is_bulk(e: Element) -> bool:
    return isinstance(e.value, Fragments) or (e.vr in dd.BULK_VRS and e.tag != 0x54001010)


def _number(x: int | float) -> int | float | None:
    return None if isinstance(x, float) and not math.isfinite(x) else x


def _float32(x: float) -> float:
    """Rounds through single precision, as text of an FL value read back."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


def flat_value(e: Element, style: str, mode: str, source: Source | None, base: str | None) -> object:
    v = e.value
    if e.vr == "SQ":
        return [flat_item(i, style, mode, source, base) for i in v or ()]
    if is_bulk(e):
        return None if v is None else bulk_json(e, mode, source, base)
    if v is None:
        return None
    if isinstance(v, bytes):
        v = np.frombuffer(v, f"<u{ob.WIDTH.get(e.vr, 1)}").tolist() if len(v) % ob.WIDTH.get(e.vr, 1) == 0 else list(v)
    if e.vr == "AT":
        return "\\".join(x if isinstance(x, str) else dd.expression(x) for x in v)
    if e.vr in ob.NUMBERS and not any(isinstance(x, str) for x in v):
        n = [y for y in (_number(x) for x in v) if y is not None]
        return n[0] if len(n) == 1 else "\\".join(map(ob.number_text, n))
    return "\\".join(x if isinstance(x, str) else ob.number_text(x) for x in v)


def _wrapped(e: Element, v: object) -> object:
    if (e.tag >> 16) & 1 == 0:
        return v
    if isinstance(v, dict) and ("InlineBinary" in v or "BulkDataURI" in v):
        return {"vr": e.vr, **v}
    return {"vr": e.vr, "Value": v}


def flat_item(item: dict, style: str, mode: str, source: Source | None, base: str | None) -> dict:
    """Inside sequences a value that can't be written becomes null."""
    out = {}
    for t in sorted(item):
        try:
            v = flat_value(item[t], style, mode, source, base)
        except ObjectError:
            v = None
        out[dd.flat_key(t, style)] = _wrapped(item[t], v)
    return out


def to_flat(o: Object, style: str = "name", mode: str = "inline", source: Source | None = None, base: str | None = None) -> dict:
    return {dd.flat_key(e.tag, style): _wrapped(e, flat_value(e, style, mode, source, base)) for e in o.elements() if e.tag != 0x00020000}


def _person(x: str) -> dict:
    parts = x.split("=")
    return {k: p for k, p in zip(("Alphabetic", "Ideographic", "Phonetic"), parts, strict=False) if p}


def standard_element(e: Element, mode: str, source: Source | None, base: str | None) -> dict:
    v, out = e.value, {"vr": e.vr}
    if e.vr == "SQ":
        if v is not None:
            out["Value"] = [{dd.hex_key(t): standard_element(i[t], mode, source, base) for t in sorted(i)} for i in v]
    elif isinstance(v, Fragments) or e.vr in dd.BULK_VRS:
        if v is not None:
            out |= bulk_json(e, mode, source, base)
    elif v is not None:
        if e.vr == "AT":
            out["Value"] = [dd.hex_key(x) for x in v]
        elif e.vr == "PN":
            out["Value"] = [_person(x) for x in v]
        elif e.vr in ("DS", "IS"):
            out["Value"] = [_plain_number(x, e.vr) for x in v]
        else:
            out["Value"] = [_number(x) if not isinstance(x, str) else x for x in v]
    k = dd.keyword(e.tag)
    if k:
        out["Keyword"] = k
    bulk = isinstance(v, Fragments) or e.vr in dd.BULK_VRS
    out["VM"] = (0 if v is None else 1) if bulk else len(v) if e.vr == "SQ" and v is not None else e.vm
    return out


def _plain_number(x: object, vr: str) -> object:
    if not isinstance(x, str):
        return _number(x)
    try:
        return int(x) if vr == "IS" or re.fullmatch(r"[+-]?\d+", x) else float(x)
    except ValueError:
        return x


def to_standard(o: Object, mode: str = "inline", source: Source | None = None, base: str | None = None) -> dict:
    return {dd.hex_key(e.tag): standard_element(e, mode, source, base) for e in o.elements() if e.tag != 0x00020000}


def dumps(doc: dict) -> str:
    """Keys in order; numbers as JSON has them."""
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def write_json(o: Object, format: str = "flat", keys: str = "name", bulk: str = "inline", source: bytes | None = None, base: str | None = None, compat: bool = False) -> str:
    src = Source(source, compat) if source is not None else None
    return dumps(to_flat(o, keys, bulk, src, base) if format == "flat" else to_standard(o, bulk, src, base))


# --- reading ---------------------------------------------------------------------------


def _text(x: object, tag: int) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return x
    if isinstance(x, int | float):
        return json.dumps(x)
    raise fail("InvalidValue", f"{dd.expression(tag)}: text expected")


def split_multi(x: str) -> list[str]:
    return x.split("\\") if x else []


def _numbers(x: object, vr: str, tag: int) -> list:
    def one(y: object) -> int | float:
        try:
            if vr in ("FL", "FD"):
                if isinstance(y, bool) or (isinstance(y, str) and not re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)", y.strip(), re.I)):
                    raise ValueError
                z = float(y)
                return _float32(z) if vr == "FL" else z
            if isinstance(y, bool | float):
                raise ValueError
            z = int(y) if not isinstance(y, str) else int(re.fullmatch(r"[+-]?\d+", y.strip())[0])
            lo, hi = _JSON_INT[vr]
            if not lo <= z < hi:
                raise ValueError
            return z
        except (ValueError, TypeError, OverflowError):
            raise fail("InvalidValue", f"{dd.expression(tag)}: {y!r} is not a {vr} number") from None

    if isinstance(x, str):
        return [one(y) for y in split_multi(x)]
    return [one(y) for y in x] if isinstance(x, list) else [one(x)]


def _tags(x: object, tag: int) -> list[int]:
    parts = split_multi(x) if isinstance(x, str) else x if isinstance(x, list) else None
    out = [dd.parse_tag(y) if isinstance(y, str) else None for y in parts or ()]
    if parts is None or any(y is None for y in out):
        raise fail("InvalidValue", f"{dd.expression(tag)}: tags expected")
    return out


def bulk_value(tag: int, vr: str, raw: bytes, syntax: str) -> tuple[str, object]:
    """A bulk value and its representation from bytes."""
    if tag == ob.PIXELS and ts.is_encapsulated(syntax):
        return "OB", pixel_sequence(raw)
    if vr not in dd.BULK_VRS:
        raise fail("UnsupportedBulkDataVr", f"{dd.expression(tag)} {vr} does not hold bulk data")
    w = ob.WIDTH.get(vr, 1)
    if len(raw) % w:
        raise fail("InvalidBulkDataLength", f"{dd.expression(tag)}: {len(raw)} bytes are not a multiple of {w}")
    return vr, ob.swap(raw, w) if ts.byte_order(syntax) == ">" else raw


def pixel_sequence(raw: bytes) -> Fragments:
    parts, at = [], 0
    while at < len(raw):
        if at + 8 > len(raw):
            raise fail("InvalidPixelSequence", "an item header is cut off")
        g, e, n = struct.unpack_from("<HHI", raw, at)
        t = g << 16 | e
        if t == ob.SEQ_END:
            break
        if t != ob.ITEM or at + 8 + n > len(raw):
            raise fail("InvalidPixelSequence", "bad item in pixel data")
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return ob.fragments_of(parts)


def _bulk_bytes(x: object, source: Source | None) -> bytes | None:
    if not isinstance(x, dict):
        return None
    if "InlineBinary" in x:
        try:
            return base64.b64decode(x["InlineBinary"], validate=True)
        except (binascii.Error, ValueError, TypeError):
            raise fail("InvalidBase64", "InlineBinary is not base64") from None
    if "BulkDataURI" in x:
        if not isinstance(x["BulkDataURI"], str):
            raise fail("InvalidBulkDataUri", "BulkDataURI is not text")
        if source is None:
            raise fail("MissingBulkDataSource", "a BulkDataURI needs a source")
        return source.slice(*parse_bulk_uri(x["BulkDataURI"]))
    return None


def _flat_element(tag: int, x: object, syntax: str, source: Source | None) -> Element:
    vr = dd.vr_of(tag)
    if isinstance(x, dict) and isinstance(x.get("vr"), str):
        vr = x["vr"]
        if vr not in dd.ALL_VRS:
            raise fail("InvalidVr", f"{dd.expression(tag)}: unknown representation {vr!r}")
        x = {k: x[k] for k in ("InlineBinary", "BulkDataURI") if k in x} or x.get("Value")
    if vr == "SQ":
        if not isinstance(x, list):
            if x is None:
                return Element(tag, vr, None)
            raise fail("InvalidValue", f"{dd.expression(tag)}: a sequence is an array")
        return Element(tag, vr, [_flat_dataset(i, syntax, source) for i in x])
    raw = _bulk_bytes(x, source)
    if raw is not None:
        return Element(tag, *bulk_value(tag, vr, raw, syntax))
    if x is None:
        return Element(tag, vr, None)
    if vr in dd.BULK_VRS:
        raise fail("InvalidValue", f"{dd.expression(tag)}: bulk data expected")
    if vr == "AT":
        return Element(tag, vr, _tags(x, tag) or None)
    if vr in ob.NUMBERS:
        return Element(tag, vr, _numbers(x, vr, tag) or None)
    t = _text(x, tag)
    return Element(tag, vr, ([t] if vr in dd.TEXT_VRS else split_multi(t)) or None)


def _flat_tag(key: str) -> int:
    t = dd.parse_tag(key)
    if t is None:
        raise fail("UnknownAttribute", f"unknown attribute {key!r}")
    return t


def _flat_dataset(x: object, syntax: str, source: Source | None) -> dict[int, Element]:
    if not isinstance(x, dict):
        raise fail("InvalidValue", "an item is an object")
    tags = {_flat_tag(k): v for k, v in x.items()}
    return {t: _flat_element(t, tags[t], syntax, source) for t in sorted(tags)}


def _root(doc: str) -> dict:
    try:
        x = json.loads(doc)
    except ValueError as err:
        raise fail("Json", str(err)) from None
    if not isinstance(x, dict):
        raise fail("InvalidJsonRoot", "the document is not an object")
    return x


def _placed(elements: list[Element], syntax: str) -> Object:
    o = Object({0x00020010: Element(0x00020010, "UI", [syntax])})
    for e in elements:
        if e.tag >> 16 != 2:
            o.data[e.tag] = e
        elif e.tag in _META and e.tag != 0x00020010 and e.value is not None:
            if e.tag != 0x00020001 or len(e.value) >= 2:
                o.meta[e.tag] = e
    return o


def from_flat(doc: str, source: bytes | None = None) -> Object:
    tags = {_flat_tag(k): v for k, v in _root(doc).items()}
    tags.pop(0x00020000, None)
    ux = tags.get(0x00020010)
    ux = ux.get("Value") if isinstance(ux, dict) else ux
    syntax = ts.normalize(ux) if isinstance(ux, str) and ux else ts.EXPLICIT_LE
    src = Source(source) if source is not None else None
    return _placed([_flat_element(t, tags[t], syntax, src) for t in sorted(tags)], syntax)


def _standard_element(tag: int, x: object, syntax: str, source: Source | None) -> Element:
    if not isinstance(x, dict) or not isinstance(x.get("vr"), str) or x["vr"] not in dd.ALL_VRS:
        raise fail("InvalidVr", f"{dd.expression(tag)}: vr is missing or unknown")
    vr, v = x["vr"], x.get("Value")
    raw = _bulk_bytes(x, source)
    if raw is not None:
        return Element(tag, *bulk_value(tag, vr, raw, syntax))
    if v is None or v == []:
        return Element(tag, vr, [] if vr == "SQ" and v == [] else None)
    if not isinstance(v, list):
        raise fail("InvalidValue", f"{dd.expression(tag)}: Value is not an array")
    if vr == "SQ":
        return Element(tag, vr, [{t: _standard_element(t, i[k], syntax, source) for t, k in sorted((_standard_tag(k), k) for k in i)} for i in v])
    if vr in dd.BULK_VRS:
        raise fail("InvalidValue", f"{dd.expression(tag)}: bulk data expected")
    if vr == "AT":
        return Element(tag, vr, _tags(v, tag))
    if vr in ob.NUMBERS:
        return Element(tag, vr, _numbers([y for y in v if y is not None], vr, tag) or None)
    if vr == "PN":
        return Element(tag, vr, ["=".join(y.get(k, "") for k in ("Alphabetic", "Ideographic", "Phonetic")).rstrip("=") if isinstance(y, dict) else y or "" for y in v])
    return Element(tag, vr, ["" if y is None else y if isinstance(y, str) else ob.number_text(y) for y in v])


def _standard_tag(k: str) -> int:
    if not re.fullmatch("[0-9A-Fa-f]{8}", k):
        raise fail("UnknownAttribute", f"{k!r} is not a tag")
    return int(k, 16)


def from_standard(doc: str, source: bytes | None = None) -> Object:
    x = {_standard_tag(k): v for k, v in _root(doc).items()}
    x.pop(0x00020000, None)
    u = x.get(0x00020010)
    u = u.get("Value") if isinstance(u, dict) else None
    syntax = ts.normalize(u[0]) if isinstance(u, list) and u and isinstance(u[0], str) else ts.EXPLICIT_LE
    src = Source(source) if source is not None else None
    return _placed([_standard_element(t, x[t], syntax, src) for t in sorted(x)], syntax)


def read_json(doc: str, format: str = "flat", source: bytes | None = None) -> Object:
    return from_flat(doc, source) if format == "flat" else from_standard(doc, source)


# --- attribute overrides ---------------------------------------------------------------


def parse_set(text: str) -> tuple[int, str]:
    """``KEY=VALUE`` to a tag and its text; the key is trimmed, the value is not."""
    k, eq, v = text.partition("=")
    if not eq:
        raise fail("InvalidOverride", f"expected KEY=VALUE, got {text!r}")
    t = parse_key(k)
    if t not in dd.BY_TAG:
        raise fail("UnknownAttribute", f"{k.strip()!r} is not in the dictionary")
    if dd.vr_of(t) == "SQ":
        raise fail("InvalidOverride", f"{k.strip()} is a sequence")
    return t, v


def parse_key(key: str) -> int:
    t = dd.parse_tag(key)
    if t is None:
        raise fail("UnknownAttribute", f"unknown attribute {key.strip()!r}")
    return t


def override(o: Object, sets: list[str] = (), removes: list[str] = ()) -> Object:
    """Sets in order, then removes, at the root; a missing attribute to remove is fine."""
    for x in sets:
        t, v = parse_set(x)
        vr = dd.vr_of(t)
        value: object = v.encode() if vr in dd.BULK_VRS else ([v] if vr in dd.TEXT_VRS else split_multi(v)) or None
        if vr in ob.NUMBERS and value:
            value = _numbers(v, vr, t)
        if vr == "AT" and value:
            value = _tags(v, t)
        (o.meta if t >> 16 == 2 else o.data)[t] = Element(t, vr, value)
    for x in removes:
        t = parse_key(x)
        (o.meta if t >> 16 == 2 else o.data).pop(t, None)
    return o
