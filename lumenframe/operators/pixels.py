"""Pixel operators on numpy arrays: frames, look-up tables, windows, redaction, resizing."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import numpy as np

from lumenframe.functions.errors import fail
from lumenframe.sources import objects as ob
from lumenframe.sources.objects import Fragments, Object

NEGATIVE_ZERO = -(1 << 31)  # an offset written as -0: the far edge


@dataclass(frozen=True)
class Box:
    """A rectangle; negative offsets count from the far edge, lengths are pixels or percent."""

    x: int
    y: int
    width: int | float
    height: int | float
    width_percent: bool = False
    height_percent: bool = False


@dataclass(frozen=True)
class Options:
    """How to render: mirrors the command line."""

    format: str = "png"
    frame: int = 0
    modality_lut: bool = True
    voi_lut: bool = True
    window_center: float | None = None
    window_width: float | None = None
    quality: int = 90
    width: int | None = None
    height: int | None = None
    max_size: int | None = None
    boxes: tuple[Box, ...] = ()
    color: tuple[int, int, int] = (0, 0, 0)
    compat: bool = False  # copy the reference's unsafe choices


@dataclass(frozen=True)
class Meta:
    rows: int
    columns: int
    samples: int
    allocated: int
    stored: int
    signed: bool
    planar: int
    frames: int
    photometric: str

    @property
    def frame_bytes(self) -> int:
        n = self.rows * self.columns * self.samples
        return -(-n // 8) if self.allocated == 1 else n * self.allocated // 8


@dataclass(frozen=True)
class Frame:
    """A rendered frame: 8-bit samples, interleaved."""

    width: int
    height: int
    samples: int
    pixels: np.ndarray = field(repr=False)  # height x width x samples


def first_number(text: str | None) -> float | None:
    """The first of several values, if it is a number."""
    x = numbers(text, first=True)
    return x[0] if x else None


def numbers(text: str | None, first: bool = False) -> list[float] | None:
    if text is None:
        return None
    out = []
    for y in text.split("\\")[: 1 if first else None]:
        y = y.strip()
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", y, re.I):
            out.append(float(y))
    return out or None


def _u16(o: Object, tag: int, name: str) -> int:
    x = first_number(o.text(tag))
    if x is None or not 0 <= x < 65536 or x != int(x):
        raise fail("MissingImageAttribute", f"missing image attribute {name}")
    return int(x)


def read_meta(o: Object) -> Meta:
    opt = lambda t, d: int(first_number(o.text(t)) if first_number(o.text(t)) is not None else d)
    rows, cols, spp = _u16(o, 0x00280010, "Rows"), _u16(o, 0x00280011, "Columns"), _u16(o, 0x00280002, "SamplesPerPixel")
    bits, stored = _u16(o, 0x00280100, "BitsAllocated"), _u16(o, 0x00280101, "BitsStored")
    if bits not in (1, 8, 16):
        raise fail("UnsupportedBitsAllocated", f"unsupported bits allocated {bits}")
    photo = (o.text(0x00280004) or ("MONOCHROME2" if spp == 1 else "RGB")).strip()
    return Meta(rows, cols, spp, bits, stored, opt(0x00280103, 0) == 1, opt(0x00280006, 0), max(1, opt(0x00280008, 1)), photo)


def native_bytes(o: Object) -> bytes:
    e = o.data.get(ob.PIXELS)
    if e is None or isinstance(e.value, Fragments) or not isinstance(e.value, bytes):
        raise fail("MissingPixelData", "no native pixel data")
    return e.value


def frame_bytes(pixels: bytes, m: Meta, index: int) -> bytes:
    n = m.frame_bytes
    part = pixels[index * n : (index + 1) * n]
    if index < 0 or len(part) < n:
        raise fail("InvalidPixelDataLength", f"frame {index} needs {n} bytes, {len(part)} are there")
    return part


def samples(part: bytes, m: Meta) -> np.ndarray:
    """Stored values of a frame as signed integers, in storage order. Single bits come most significant first."""
    n = m.rows * m.columns * m.samples
    if m.allocated == 1:
        return np.unpackbits(np.frombuffer(part, np.uint8))[:n].astype(np.int64)
    raw = np.frombuffer(part, np.uint8 if m.allocated == 8 else "<u2")[:n].astype(np.int64)
    return signed(raw, m.stored, m.signed)


def signed(raw: np.ndarray, stored: int, is_signed: bool) -> np.ndarray:
    if stored == 0:
        return np.zeros_like(raw)
    b = min(stored, 16)
    raw = raw & ((1 << b) - 1)
    return np.where(raw >= 1 << (b - 1), raw - (1 << b), raw) if is_signed else raw


def modality(v: np.ndarray, slope: float | None, intercept: float | None) -> np.ndarray:
    s, i = 1.0 if slope is None else slope, 0.0 if intercept is None else intercept
    v = v.astype(np.float64)
    return v if s == 1.0 and i == 0.0 else v * s + i


def normalize(v: np.ndarray) -> np.ndarray:
    """Spreads the range over 0..255; a flat frame is black."""
    lo, hi = np.nanmin(v), np.nanmax(v)
    if abs(hi - lo) < np.finfo(np.float64).eps:
        return np.zeros(v.shape, np.uint8)
    return np.trunc(np.clip((v - lo) / (hi - lo) * 255.0, 0, 255)).astype(np.uint8)


def window_edges(center: float, width: float) -> tuple[float, float]:
    middle, half = center - 0.5, (width - 1.0) / 2.0
    return middle - half, middle + half


def window(v: np.ndarray, center: float | None, width: float | None) -> np.ndarray:
    """Intensity window; falls back to the full range if the window misses nearly all values."""
    if center is None or width is None:
        return normalize(v)
    den = max(width - 1.0, 1.0)
    lower, upper = window_edges(center, width)
    lo, hi = float(np.nanmin(v)), float(np.nanmax(v))
    overlap = max(0.0, min(upper, hi) - max(lower, lo)) / max(hi - lo, 1.0)
    if upper <= lo or lower >= hi or overlap < 0.05 or int(((v >= lower) & (v <= upper)).sum()) * 100 < v.size:
        return normalize(v)
    out = np.trunc(np.clip(((v - (center - 0.5)) / den + 0.5) * 255.0, 0, 255))
    return np.where(v <= lower, 0, np.where(v > upper, 255, out)).astype(np.uint8)


def resolve_window(o: Object, opt: Options) -> tuple[float | None, float | None]:
    if opt.window_width is not None and opt.window_center is not None:
        return opt.window_center, opt.window_width
    if opt.window_center is not None:
        return opt.window_center, None
    c, w = first_number(o.text(0x00281050)), first_number(o.text(0x00281051))
    return (None, None) if c is None or (w is not None and w <= 0) else (c, w)


def check_window(opt: Options) -> None:
    if opt.window_width is not None:
        if opt.window_center is None:
            raise fail("InvalidWindow", "a window width needs a window center")
        if not opt.window_width > 0:
            raise fail("InvalidWindow", "window width must be greater than zero")


def _palette(o: Object, k: int) -> tuple[np.ndarray, int, int]:
    d, e = o.data.get(0x00281101 + k), o.data.get(0x00281201 + k)
    if d is None or not d.value or len(d.value) < 3 or e is None or not isinstance(e.value, bytes):
        raise fail("MissingImageAttribute", "missing palette look-up table")
    n, first, bits = (int(x) for x in d.value[:3])
    n = n or 65536
    if bits > 8 or len(e.value) >= 2 * n:
        v = np.frombuffer(e.value[: len(e.value) // 2 * 2], "<u2").astype(np.int64)
        v = v * 255 // ((1 << max(bits, 8)) - 1) if bits > 8 else v
    else:
        v = np.frombuffer(e.value, np.uint8).astype(np.int64)
    return np.clip(v[:n], 0, 255).astype(np.uint8), n, first


def render_values(o: Object, m: Meta, v: np.ndarray, opt: Options) -> np.ndarray:
    """8-bit samples, rows x columns x samples, of one frame's stored values."""
    shape = (m.rows, m.columns)
    if m.samples == 1:
        x = modality(v, first_number(o.text(0x00281053)), first_number(o.text(0x00281052))) if opt.modality_lut else v.astype(np.float64)
        if m.photometric == "PALETTE COLOR":
            tables = [_palette(o, k) for k in range(3)]
            _, n, first = tables[0]
            at = np.clip(np.floor(np.abs(x) + 0.5) * np.sign(x) - first, 0, n - 1).astype(np.int64)
            if any(len(t) <= at.max(initial=0) for t, _, _ in tables):
                raise fail("MissingImageAttribute", "a palette channel is shorter than its indexes")
            return np.stack([t[at] for t, _, _ in tables], -1).reshape(*shape, 3)
        if m.photometric not in ("MONOCHROME1", "MONOCHROME2"):
            raise fail("UnsupportedPhotometricInterpretation", f"unsupported photometric interpretation {m.photometric}")
        y = window(x, *resolve_window(o, opt)) if opt.voi_lut else normalize(x)
        return (255 - y if m.photometric == "MONOCHROME1" else y).reshape(*shape, 1)
    if m.samples != 3:
        raise fail("UnsupportedSamplesPerPixel", f"unsupported samples per pixel {m.samples}")
    if m.photometric not in ("RGB", "YBR_FULL", "YBR_FULL_422"):
        raise fail("UnsupportedPhotometricInterpretation", f"unsupported photometric interpretation {m.photometric}")
    if m.allocated == 1:
        raise fail("UnsupportedBitsAllocated", "single-bit colour is not supported")
    x = v.reshape(3, *shape).transpose(1, 2, 0) if m.planar == 1 else v.reshape(*shape, 3)
    if m.allocated == 16:
        top = (1 << min(max(m.stored, 1), 16)) - 1
        x = np.trunc(np.clip(x.astype(np.float64) / top * 255.0, 0, 255))
    return x.astype(np.uint8)


def half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def luma(color: tuple[int, int, int]) -> int:
    r, g, b = color
    return min(255, max(0, half_away(0.2126 * r + 0.7152 * g + 0.0722 * b)))


def scale_to_depth(v: int, stored: int) -> int:
    return (v * ((1 << min(max(stored, 1), 16)) - 1) + 127) // 255


def axis_start(offset: int, extent: int) -> int:
    if offset == NEGATIVE_ZERO:
        return extent
    return min(offset, extent) if offset >= 0 else extent - min(-offset, extent)


def axis_length(length: int | float, percent: bool, extent: int) -> int:
    return half_away(extent * min(max(float(length), 0.0), 100.0) / 100.0) if percent else int(length)


def clamped(box: Box, width: int, height: int) -> tuple[int, int, int, int]:
    """x0, x1, y0, y1 inside the frame."""
    x, y = axis_start(box.x, width), axis_start(box.y, height)
    return x, min(x + axis_length(box.width, box.width_percent, width), width), y, min(y + axis_length(box.height, box.height_percent, height), height)


def redact_frame(part: bytes, m: Meta, boxes: tuple[Box, ...], color: tuple[int, int, int]) -> bytes:
    """Fills boxes in a native frame at its own depth."""
    if not boxes:
        return part
    if (m.samples, m.allocated) not in ((1, 1), (1, 8), (1, 16), (3, 8), (3, 16)):
        raise fail("UnsupportedSamplesPerPixel", f"cannot redact {m.samples} samples of {m.allocated} bits")
    n = m.rows * m.columns * m.samples
    flat = np.unpackbits(np.frombuffer(part, np.uint8)) if m.allocated == 1 else np.frombuffer(part, np.uint8 if m.allocated == 8 else "<u2").copy()
    v = flat[:n].reshape((m.samples, m.rows, m.columns) if m.samples == 3 and m.planar == 1 else (m.rows, m.columns, m.samples))
    fill = [luma(color)] if m.samples == 1 else list(color)
    fill = [int(f >= 128) if m.allocated == 1 else scale_to_depth(f, m.stored) for f in fill]
    for box in boxes:
        x0, x1, y0, y1 = clamped(box, m.columns, m.rows)
        for k, f in enumerate(fill):
            if m.samples == 3 and m.planar == 1:
                v[k, y0:y1, x0:x1] = f
            else:
                v[y0:y1, x0:x1, k] = f
    flat[:n] = v.ravel()
    return (np.packbits(flat) if m.allocated == 1 else flat).tobytes()


def output_size(width: int, height: int, want_w: int | None, want_h: int | None, most: int | None) -> tuple[int, int] | None:
    """Size after resizing; None where the options say nothing or contradict each other."""

    def ratio(new: int, ref: int, x: int) -> int:
        return x if ref == 0 else max(1, half_away(new / ref * x))

    if most is not None:
        if want_w is not None or want_h is not None:
            return None
        return (most, ratio(most, width, height)) if width >= height else (ratio(most, height, width), most)
    if want_w is not None and want_h is not None:
        return want_w, want_h
    if want_w is not None:
        return want_w, ratio(want_w, width, height)
    return (ratio(want_h, height, width), want_h) if want_h is not None else None


def _lanczos(old: int, new: int) -> np.ndarray:
    """Weights (new x old) of a three-lobed filter, widened when shrinking."""
    scale = old / new
    wide = max(scale, 1.0)
    center = (np.arange(new) + 0.5) * scale
    x = (np.arange(old)[None, :] + 0.5 - center[:, None]) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(f: Frame, opt: Options) -> Frame:
    size = output_size(f.width, f.height, opt.width, opt.height, opt.max_size)
    if size is None or size == (f.width, f.height):
        return f
    w, h = size[0] & 0xFFFF, size[1] & 0xFFFF
    if not w or not h:
        raise fail("InvalidSize", "an output size of zero")
    x = np.einsum("hr,rcs->hcs", _lanczos(f.height, h), f.pixels.astype(np.float64))
    x = np.einsum("wc,hcs->hws", _lanczos(f.width, w), x)
    return Frame(w, h, f.samples, np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8))


def draw(f: Frame, boxes: tuple[Box, ...], color: tuple[int, int, int]) -> Frame:
    """Fills boxes in a rendered frame."""
    if not boxes:
        return f
    p = f.pixels.copy()
    for box in boxes:
        x0, x1, y0, y1 = clamped(box, f.width, f.height)
        p[y0:y1, x0:x1] = luma(color) if f.samples == 1 else color
    return replace(f, pixels=p)


def render(o: Object, opt: Options, index: int) -> Frame:
    """One frame of an object with native pixel data, resized and with its boxes."""
    m = read_meta(o)
    if not 0 <= index < m.frames:
        raise fail("FrameOutOfRange", f"frame {index} of {m.frames}")
    p = render_values(o, m, samples(frame_bytes(native_bytes(o), m, index), m), opt)
    return draw(resize(Frame(m.columns, m.rows, p.shape[2], p), opt), opt.boxes, opt.color)


def default_fps(o: Object) -> float | None:
    """Frame rate from the object; a first tag that is present but not positive gives none."""
    x = first_number(o.text(0x00089459))
    for tag in (0x00082144, 0x00180040):
        x = first_number(o.text(tag)) if x is None else x
    if x is None:
        t = first_number(o.text(0x00181063))
        x = 1000.0 / t if t is not None and t > 0 else None
    if x is None:
        v = [y for y in numbers(o.text(0x00181065)) or () if math.isfinite(y) and y > 0]
        x = 1000.0 / (sum(v) / len(v)) if v else None
    return x if x is not None and math.isfinite(x) and x > 0 else None


def parse_box(text: str) -> Box:
    """``X,Y,W,H``; -0 is the far edge, lengths may end in %."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 4:
        raise fail("InvalidBox", f"expected X,Y,W,H, got {text!r}")

    def coordinate(p: str) -> int:
        if not re.fullmatch(r"[+-]?\d+", p):
            raise fail("InvalidBox", f"{p!r} is not a coordinate")
        return NEGATIVE_ZERO if p.startswith("-") and int(p) == 0 else int(p)

    def extent(p: str) -> tuple[int | float, bool]:
        if p.endswith("%"):
            try:
                x = float(p[:-1])
            except ValueError:
                x = math.nan
            if not math.isfinite(x) or x < 0:
                raise fail("InvalidBox", f"{p!r} is not a percentage")
            return x, True
        if not re.fullmatch(r"\+?\d+", p):
            raise fail("InvalidBox", f"{p!r} is not a length")
        return int(p), False

    (w, wp), (h, hp) = extent(parts[2]), extent(parts[3])
    return Box(coordinate(parts[0]), coordinate(parts[1]), w, h, wp, hp)


def parse_color(text: str) -> tuple[int, int, int]:
    t = text.strip()
    if re.fullmatch("#[0-9A-Fa-f]{6}", t):
        return int(t[1:3], 16), int(t[3:5], 16), int(t[5:7], 16)
    parts = [p.strip() for p in t.split(",")]
    if len(parts) != 3 or not all(re.fullmatch(r"\+?\d+", p) and int(p) < 256 for p in parts):
        raise fail("InvalidColor", f"expected R,G,B or #RRGGBB, got {text!r}")
    return tuple(map(int, parts))


def frame_path(path: str, number: int) -> str:
    """``STEM_000001.EXT`` for the frame numbers from 1."""
    head, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return f"{head}{slash}{stem or name}_{number:06d}{dot if stem else ''}{ext if stem else ''}"
