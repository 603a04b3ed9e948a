"""PNG and baseline JPEG encoders and the RLE codec, in numpy and the standard library."""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

from lumenframe.functions.errors import fail


def png(pixels: np.ndarray) -> bytes:
    """8-bit grey or RGB; rows x columns x samples."""
    h, w, s = pixels.shape
    raw = np.zeros((h, 1 + w * s), np.uint8)
    raw[:, 1:] = pixels.reshape(h, w * s)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if s == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_QUANT_Y = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
_QUANT_C = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
_DC_Y, _DC_C = ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))), ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1] + [0] * 5, list(range(12)))
_AC_Y = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")))
_AC_C = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", ""))))


@cache
def _codes(which: str) -> dict[int, tuple[int, int]]:
    counts, values = {"dy": _DC_Y, "dc": _DC_C, "ay": _AC_Y, "ac": _AC_C}[which]
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[values[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return out


def quant_table(base: list[int], quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    s = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * s + 50) // 100, 1, 255)


@cache
def _cosines() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    c = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def jpeg(pixels: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JPEG without subsampling."""
    h, w, s = pixels.shape
    x = pixels.astype(np.float64)
    if s == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        x = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], -1)
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    tables = [quant_table(_QUANT_Y, quality), quant_table(_QUANT_C, quality)]
    c = _cosines()
    blocks = []
    for k in range(s):
        p = x[..., k].reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        f = np.rint((c @ p @ c.T).reshape(-1, 64) / tables[min(k, 1)]).astype(int)
        blocks.append(f[:, _ZIGZAG])
    bits: list[str] = []
    before = [0] * s
    for i in range(len(blocks[0])):
        for k in range(s):
            z = blocks[k][i]
            dc, ac = _codes("dy" if k == 0 else "dc"), _codes("ay" if k == 0 else "ac")
            put = lambda pair: bits.append(format(pair[0], f"0{pair[1]}b"))
            d = int(z[0]) - before[k]
            before[k] = int(z[0])
            n = abs(d).bit_length()
            put(dc[n])
            if n:
                put((d if d > 0 else d + (1 << n) - 1, n))
            last = 0
            for at in np.flatnonzero(z[1:]) + 1:
                run = int(at) - last - 1
                while run > 15:
                    put(ac[0xF0])
                    run -= 16
                v = int(z[at])
                n = abs(v).bit_length()
                put(ac[run << 4 | n])
                put((v if v > 0 else v + (1 << n) - 1, n))
                last = int(at)
            if last < 63:
                put(ac[0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k in range(min(s, 2)):
        out += seg(0xDB, bytes([k]) + bytes(tables[k][_ZIGZAG].tolist()))
    out += seg(0xC0, struct.pack(">BHHB", 8, h, w, s) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(s)))
    for ident, (counts, values) in ((0x00, _DC_Y), (0x10, _AC_Y), (0x01, _DC_C), (0x11, _AC_C)):
        if s == 3 or not ident & 1:
            out += seg(0xC4, bytes([ident]) + bytes(counts) + bytes(values))
    return out + seg(0xDA, bytes([s]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(s)) + b"\0\x3f\0") + scan + b"\xff\xd9"


def rle_encode(planes: list[bytes]) -> bytes:
    """One frame from its byte planes."""
    parts = []
    for p in planes:
        out, i, n = bytearray(), 0, len(p)
        while i < n:
            j = i
            while j + 1 < n and p[j + 1] == p[i] and j - i < 127:
                j += 1
            if j > i:
                out += bytes([257 - (j - i + 1), p[i]])
                i = j + 1
                continue
            j = i
            while j + 1 < n and j - i < 127 and (j + 2 >= n or p[j + 1] != p[j + 2]) and p[j] != p[j + 1]:
                j += 1
            out += bytes([j - i]) + p[i : j + 1]
            i = j + 1
        parts.append(bytes(out) + b"\0" * (len(out) % 2))
    at, offsets = 64, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    return struct.pack("<16I", len(parts), *offsets, *[0] * (15 - len(offsets))) + b"".join(parts)


def rle_decode(data: bytes, size: int) -> list[bytes]:
    """Byte planes of one frame, each of ``size`` bytes."""
    if len(data) < 64:
        raise fail("InvalidPixelSequence", "RLE header is cut off")
    n, *offsets = struct.unpack_from("<16I", data)
    if n > 15:
        raise fail("InvalidPixelSequence", "too many RLE segments")
    planes = []
    for k in range(n):
        at, end = offsets[k], offsets[k + 1] if k + 1 < n else len(data)
        out = bytearray()
        while at < end and len(out) < size:
            c = data[at]
            if c < 128:
                out += data[at + 1 : at + 2 + c]
                at += c + 2
            elif c > 128:
                out += data[at + 1 : at + 2] * (257 - c)
                at += 2
            else:
                at += 1
        if len(out) < size:
            raise fail("InvalidPixelSequence", "an RLE segment is too short")
        planes.append(bytes(out[:size]))
    return planes
