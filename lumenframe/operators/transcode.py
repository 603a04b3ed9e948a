"""Changing transfer syntaxes, recompressing renders and redacting objects."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import fail
from lumenframe.operators import images
from lumenframe.operators import pixels as px
from lumenframe.sources import objects as ob
from lumenframe.sources.objects import Element, Fragments, Object

SIDECARS = (0x7FE00001, 0x7FE00002, 0x7FE00003)


def clone(o: Object) -> Object:
    """A copy whose elements may be replaced; elements themselves are never changed."""
    return Object(dict(o.meta), dict(o.data))


def pixel_kind(o: Object) -> str:
    e = o.data.get(ob.PIXELS)
    if e is None or e.vr == "SQ" or e.value is None:
        return "absent"
    return "encapsulated" if isinstance(e.value, Fragments) else "native"


def _set(o: Object, tag: int, vr: str, value: object) -> None:
    o.data[tag] = Element(tag, vr, value)


def _frames_of(f: Fragments, n: int) -> list[bytes]:
    """Frames of fragments, by the offset table or one fragment a frame."""
    if len(f.parts) == n:
        return list(f.parts)
    if n == 1:
        return [b"".join(f.parts)]
    starts, at = {}, 0
    for k, p in enumerate(f.parts):
        starts[at] = k
        at += len(p) + 8
    if len(f.offsets) == n and all(x in starts for x in f.offsets):
        cut = [starts[x] for x in f.offsets] + [len(f.parts)]
        return [b"".join(f.parts[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    raise fail("DecodePixelData", f"{len(f.parts)} fragments for {n} frames without an offset table")


def decode(o: Object) -> Object:
    """Native pixel data in explicit little endian."""
    uid = o.syntax
    m = px.read_meta(o)
    parts = _frames_of(o.data[ob.PIXELS].value, m.frames)
    if uid == ts.ENCAPSULATED_LE:
        raw = b"".join(p[: m.frame_bytes] for p in parts)
    elif uid == ts.RLE:
        n, width, out = m.rows * m.columns, max(1, m.allocated // 8), []
        for p in parts:
            planes = images.rle_decode(p, n)
            if len(planes) != width * m.samples:
                raise fail("DecodePixelData", f"{len(planes)} RLE segments for {m.samples} samples of {width} bytes")
            a = np.zeros((n, m.samples, width), np.uint8)
            for k, plane in enumerate(planes):  # most significant byte first
                a[:, k // width, width - 1 - k % width] = np.frombuffer(plane, np.uint8)
            out.append(a.tobytes())
        raw = b"".join(out)
    else:
        raise fail("UnsupportedSourceTransferSyntax", f"unsupported source transfer syntax {uid}")
    _set(o, ob.PIXELS, "OB" if m.allocated <= 8 else "OW", raw + b"\0" * (len(raw) % 2))
    for t in SIDECARS:
        o.data.pop(t, None)
    if m.samples > 1:
        _set(o, 0x00280004, "CS", ["RGB"])
        _set(o, 0x00280006, "US", [0])
    else:
        if m.photometric not in ("MONOCHROME1", "MONOCHROME2", "PALETTE COLOR"):
            _set(o, 0x00280004, "CS", ["MONOCHROME2"])
        o.data.pop(0x00280006, None)
    o.meta[0x00020010] = Element(0x00020010, "UI", [ts.EXPLICIT_LE])
    return o


def encode(o: Object, uid: str, quality: int = 90) -> Object:
    """Encapsulated pixel data from native."""
    m, raw = px.read_meta(o), px.native_bytes(o)
    parts = []
    for k in range(m.frames):
        p = px.frame_bytes(raw, m, k)
        if uid == ts.RLE:
            if m.allocated == 1:
                raise fail("EncodePixelData", "single-bit frames have no RLE form here")
            width = m.allocated // 8
            a = np.frombuffer(p, np.uint8)
            a = a.reshape(m.samples, -1, width).transpose(1, 0, 2) if m.samples > 1 and m.planar == 1 else a.reshape(-1, m.samples, width)
            p = images.rle_encode([a[:, s, w].tobytes() for s in range(m.samples) for w in range(width - 1, -1, -1)])
        elif uid == ts.JPEG_BASELINE:
            if m.allocated != 8 or m.stored != 8 or m.signed or m.samples not in (1, 3):
                raise fail("EncodePixelData", "JPEG baseline takes unsigned 8-bit samples")
            v = np.frombuffer(p, np.uint8)[: m.rows * m.columns * m.samples]
            v = v.reshape(3, m.rows, m.columns).transpose(1, 2, 0) if m.samples == 3 and m.planar == 1 else v.reshape(m.rows, m.columns, m.samples)
            p = images.jpeg(v, quality)
        parts.append(p + b"\0" * (len(p) % 2))
    offsets = np.cumsum([0, *[len(p) + 8 for p in parts[:-1]]]).tolist()
    o.data[ob.PIXELS] = Element(ob.PIXELS, "OB", Fragments(offsets, parts))
    if uid in (ts.RLE, ts.JPEG_BASELINE) and m.samples > 1:
        _set(o, 0x00280006, "US", [0])
    return o


def transcode(o: Object, target: str, quality: int = 90) -> Object:
    """The object in another transfer syntax; the same one is returned as it is, even if unknown."""
    uid = ts.normalize(target)
    if uid == o.syntax:
        return o
    cap = ts.capability(uid)
    if cap is None:
        raise fail("UnknownTransferSyntax", f"unknown transfer syntax {uid}")
    kind = pixel_kind(o)
    if kind != "absent" and not cap.can_encode_pixel_data:
        raise fail("UnsupportedTargetTransferSyntax", f"unsupported target transfer syntax {uid}")
    o = clone(o)
    if kind == "encapsulated":
        o = decode(o)
    if kind != "absent" and cap.encapsulated:
        o = encode(o, uid, quality)
    o.meta[0x00020010] = Element(0x00020010, "UI", [uid])
    return o


def native(o: Object) -> Object:
    return transcode(o, ts.EXPLICIT_LE) if pixel_kind(o) == "encapsulated" else o


def redact(o: Object, boxes: tuple[px.Box, ...], color: tuple[int, int, int] = (0, 0, 0), target: str | None = None) -> Object:
    """Fills boxes in every frame at native depth and writes the target syntax, by default the object's own."""
    uid = ts.normalize(target or o.syntax)
    cap = ts.capability(uid)
    if cap is None or not cap.can_transcode_to:
        raise fail("UnsupportedTargetTransferSyntax", f"unsupported target transfer syntax {uid}")
    n = clone(transcode(o, ts.EXPLICIT_LE))
    m, raw = px.read_meta(n), px.native_bytes(n)
    out = b"".join(px.redact_frame(px.frame_bytes(raw, m, k), m, boxes, color) for k in range(m.frames))
    n.data[ob.PIXELS] = replace(n.data[ob.PIXELS], value=out + raw[len(out) :])
    return transcode(n, uid)


def render_frames(o: Object, opt: px.Options, every: bool = False) -> list[tuple[int, int, int, int, str, bytes]]:
    """(width, height, samples, bits, format, bytes) of the chosen frame or of all."""
    px.check_window(opt)
    n = native(o)
    m = px.read_meta(n)
    index = range(m.frames) if every else [opt.frame]
    if opt.format == "raw":
        if opt.boxes and not opt.compat:
            raise fail("UnsafeRedaction", "raw output holds untouched pixels; redact the object instead")
        return [(m.columns, m.rows, m.samples, m.allocated, "raw", px.frame_bytes(px.native_bytes(n), m, k)) for k in index]
    if opt.format not in ("png", "jpeg"):
        raise fail("UnsupportedOutput", f"{opt.format} output needs an external encoder that is not part of this engine")
    out = []
    for k in index:
        f = px.render(n, opt, k)
        out.append((f.width, f.height, f.samples, 8, opt.format, images.png(f.pixels) if opt.format == "png" else images.jpeg(f.pixels, opt.quality)))
    return out


def render_object(o: Object, opt: px.Options, target: str) -> Object:
    """All frames rendered to 8 bits and written back; colour renders of palettes become three samples."""
    n = clone(native(o))
    m = px.read_meta(n)
    plain = replace(opt, width=None, height=None, max_size=None, boxes=())
    frames = [px.render(n, plain, k) for k in range(m.frames)]
    spp = frames[0].samples
    raw = b"".join(f.pixels.tobytes() for f in frames)
    for t, vr, v in ((0x00280100, "US", 8), (0x00280101, "US", 8), (0x00280102, "US", 7), (0x00280103, "US", 0), (0x00280002, "US", spp)):
        _set(n, t, vr, [v])
    _set(n, 0x00280004, "CS", ["RGB" if spp == 3 else "MONOCHROME2"])
    if spp == 3:
        _set(n, 0x00280006, "US", [0])
    for t in (0x00281050, 0x00281051, 0x00281052, 0x00281053, 0x00281101, 0x00281102, 0x00281103, 0x00281201, 0x00281202, 0x00281203):
        n.data.pop(t, None)
    _set(n, ob.PIXELS, "OB", raw + b"\0" * (len(raw) % 2))
    return transcode(n, target, opt.quality)
