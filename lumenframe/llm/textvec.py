"""Vectorised word scanning over Arrow text columns.

Texts of a batch are treated as one UTF-8 buffer with document offsets.  Words are
maximal runs of bytes outside ``\\x20\\x09-\\x0D``; as those bytes never occur inside a
multi-byte sequence this equals the code-point definition.  Words and lines get 64-bit
hashes from prefix sums, so no Python loop touches single words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Rows are handled in runs of about this many text bytes; a longer text is a run of its own.
SLICE_BYTES = 1 << 20
TIDY_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([int(x) & 0xFFFFFFFFFFFFFFFF], dtype=_U))[0])


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Hashes of spans come from prefix sums over blocks of so many bytes; a longer span is summed block by block.
BLOCK = 1 << 16


def _powers(base: int) -> np.ndarray:
    a = np.full(BLOCK + 1, _U(base), dtype=_U)
    a[0] = 1
    return np.multiply.accumulate(a)


_POWER, _INVERSE = _powers(_BASE), _powers(_BASE_INV)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as an array; the first one if names clash."""
    return batch.column(batch.schema.names.index(name))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if off is not None and len(arr) else np.zeros(1, np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def runs(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) that cover the array, each of at most ``most`` bytes or one row."""
    _, o = flat(arr)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    tidy(int(o[-1]))


_libc = ctypes.CDLL(None)
_since = 0


def tidy(done: int = TIDY_BYTES) -> None:
    """After every TIDY_BYTES of text: freed memory goes back to the system, so that a worker between tasks is small."""
    global _since
    _since += done
    if _since >= TIDY_BYTES:
        _since = 0
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):  # glibc
            _libc.malloc_trim(0)


class Words:
    """Words of the texts in one run of rows.

    inside: which bytes belong to words, if not all but white space.
    start, end: byte places of the words; first: index of each document's first word,
    with the total at the end; hash: one 64-bit hash a word.
    """

    def __init__(self, arr: pa.Array, lower: bool = False, inside: np.ndarray | None = None):
        self.buf, self.off = flat(arr)
        self.n_docs = len(self.off) - 1
        n = len(self.buf)
        self.inside = ~SPACE[self.buf] if inside is None else inside[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.off] = True
        w = self.inside
        prev = np.empty(n, dtype=bool)
        nxt = np.empty(n, dtype=bool)
        if n:
            prev[0], prev[1:] = False, w[:-1]
            nxt[-1], nxt[:-1] = False, w[1:]
        self.start = np.flatnonzero(w & (~prev | edge[:n]))
        self.end = np.flatnonzero(w & (~nxt | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.hash = self.spans(self.start, self.end, lower)

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of byte spans, whose starts and ends ascend."""
        table = _LOWER if lower else _TABLE
        out = np.empty(len(start), _U)
        i = 0
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + BLOCK, "right"))
            if j <= i:
                out[i] = _U(self._long(table, lo, int(end[i])))
                i += 1
                continue
            hi = int(end[j - 1])
            c = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum(table[self.buf[lo:hi]] * _POWER[: hi - lo], out=c[1:])
            a = start[i:j] - lo
            out[i:j] = (c[end[i:j] - lo] - c[a]) * _INVERSE[a]
            i = j
        return mix(out + (end - start).astype(_U) * _U(0xA0761D6478BD642F))

    def _long(self, table: np.ndarray, start: int, end: int) -> int:
        total, power = 0, 1
        for at in range(start, end, BLOCK):
            part = table[self.buf[at : min(at + BLOCK, end)]]
            total += power * int((part * _POWER[: len(part)]).sum(dtype=_U))
            power = power * int(_POWER[BLOCK]) & 0xFFFFFFFFFFFFFFFF
        return total & 0xFFFFFFFFFFFFFFFF

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each document."""
        c = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """k-word windows within documents: index of their first word, document, hash."""
        doc = self.doc_of_word()
        m = len(doc) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(doc[:m] == doc[k - 1 :])
        h = self.hash[at]
        for i in range(1, k):
            h = mix(h * _U(0xE7037ED1A0B428DB) + self.hash[at + i])
        return at, doc[at], h

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between newlines: start, end, document; a text of no bytes has none.

        Starts and ends both ascend in page order, so sorting each pairs them.
        """
        nl = np.flatnonzero(self.buf == 10)
        full = np.flatnonzero(np.diff(self.off) > 0)
        start = np.sort(np.concatenate([self.off[full], nl + 1]))
        end = np.sort(np.concatenate([self.off[full + 1], nl]))
        count = np.bincount(np.searchsorted(self.off, nl, "right") - 1, minlength=self.n_docs)[full] + 1
        return start, end, np.repeat(full, count)


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def repeated(a: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    s = np.sort(a)
    if len(s) < 2:
        return np.zeros(len(a), dtype=bool)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(a), dtype=bool)
    twice = sorted_distinct(twice)
    at = np.searchsorted(twice, a)
    at[at == len(twice)] = 0
    return twice[at] == a
