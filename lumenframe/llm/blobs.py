"""Columnar shuffles: a row is one bucket's share of a batch, packed in a binary column.

Millions of small records go through a shuffle as a few thousand packed arrays; the
bucket number is the partition, so buckets neither collide nor go missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenframe.llm.textvec import tidy

SCHEMA = "bucket int, blob binary"
_NAMES = ["bucket", "blob"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths in one byte string.

    Longer arrays go byte plane by byte plane, each compressed where that saves room: the
    high bytes of steps, small counts and tiers do, hashes don't.
    """
    head, body = [len(arrays)], []
    for a in arrays:
        size = a.dtype.itemsize
        head += [_CODES[a.dtype.str], len(a)]
        if len(a) < PLANES or a.dtype.str == HASHES:
            body.append(np.ascontiguousarray(a).tobytes())
            continue
        for x in np.ascontiguousarray(a).view("u1").reshape(-1, size).T:
            raw = x.tobytes()
            small = _squeeze.compress(raw)
            body += [len(small).to_bytes(4, "little"), small] if len(small) < 0.97 * len(raw) else [b"\0\0\0\0", raw]
    return np.array(head, np.int64).tobytes() + b"".join(body)


PLANES = 512  # least items of an array that goes by planes
HASHES = "<u8"  # arrays of this type are hashes, which do not compress
_TYPES = ["|u1", "<u2", "<u4", "<u8", "<i8", *(f"|S{k}" for k in range(1, 9))]
_CODES = {t: i for i, t in enumerate(_TYPES)}
_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def unpack(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * k, 8)
    at, out = 8 + 16 * k, []
    for code, n in head.reshape(-1, 2).tolist():
        t = np.dtype(_TYPES[code])
        if n < PLANES or _TYPES[code] == HASHES:
            out.append(np.frombuffer(blob, t, n, at))
            at += t.itemsize * n
            continue
        a = np.empty((n, t.itemsize), "u1")
        for i in range(t.itemsize):
            m = int.from_bytes(blob[at : at + 4], "little")
            a[:, i] = np.frombuffer(_expand.decompress(blob[at + 4 : at + 4 + m], n) if m else blob[at + 4 : at + 4 + n], "u1")
            at += 4 + (m or n)
        out.append(a.view(t).ravel())
    return out


def gathered(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Concatenates unpacked blobs array by array, and empties the list to free them."""
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts.clear()
    return out


def rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=_NAMES)


def split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket and the n + 1 bounds of the buckets in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + n[i] - 1 of all i, one after another."""
    n = n.astype(np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def cut(x: np.ndarray, width: int) -> np.ndarray:
    """The high bytes of uint64 values as byte strings of a width."""
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view("u1").reshape(-1, 8)[:, 8 - width :]).view(f"|S{width}").ravel()


def uncut(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), 8), "u1")
    out[:, 8 - width :] = np.ascontiguousarray(x).view("u1").reshape(-1, width)
    return out.view("<u8").ravel()


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Moves each row to the partition of its bucket."""
    return df.repartitionById(n, "bucket")


def by_partition(df: DataFrame, work: Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs work once over all unpacked blobs of a partition; partitions are bounded by the bucket number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in it for x in b.column(1).to_pylist()]
        if parts:
            yield from work(parts)
        tidy()

    return df.mapInArrow(run, schema)
