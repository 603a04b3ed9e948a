"""Line dedup: a deletion-neighbourhood join over all lines of a corpus.

A line is its sequence of words (A-Z lowered, white space ignored).  Lines of fewer than
``min_words`` words are never removed.  Two lines are near if they are equal, or if as
many word edits (replace, insert, delete) turn one into the other as the longer one's
length allows: none under ``edit_words`` words, then one, and one per ``edit_every`` words
from 2 * edit_every on.  A line is removed if a near line stands earlier, in the order of
(id, line number); the earliest stays.

1. Every distinct line sends, once per task, its hash with its first place, and hashes
   of its leading and trailing halves.  One edit leaves a half intact, so only lines
   that share a half with a different line can have a near, unequal one.
2. Those lines emit all variants with one word deleted, and themselves, as hashed keys
   with the deleted place.  Equal keys are joined: the same variant at the same place
   means a replacement, a variant equal to a whole line a deletion or insertion.  The
   earliest line of each key comes from a map-side combined minimum, so no group is
   collected and no pairs are enumerated.
3. Each line and its earliest partner are fetched and their edit distance is verified.
4. Lines that may differ by k >= 2 words: an edit touches at most q of a line's windows of
   q words, so each of two near lines lacks at most kq windows of the other, and the kq + 1
   least windows (by hash, repeats numbered) of both share one.  Only windows shared by
   different lines go on.  A line not yet removed is compared with the earliest line of
   each shared window, then, if it still stands, with the other earlier ones; lengths and
   word histograms drop most pairs before the lines are fetched and verified.

Defined cases: null and empty texts have no lines; a text whose lines all go is empty;
rows that share an id share their places and lose the same lines; other columns pass
through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import blobs, common
from lumenframe.llm.textvec import Words, flat, mix, runs

_U = np.uint64
MIN_WORDS, EDIT_WORDS, EDIT_EVERY = 1, 10, 20
BINS = 16
HASH = 44  # bits of a window; a run of texts has fewer than 2**20 long lines, a longer text fewer by its words
#: Keys up to this many are looked up in broadcast sorted arrays; more go through joins.
LOOKUP_KEYS = 3_000_000
_ROLL = 0xD1342543DE82EF95
_ROLL_INV = pow(_ROLL, -1, 1 << 64)


def bound(n: np.ndarray, edit_words: int, every: int) -> np.ndarray:
    """Word edits allowed where the longer line has n words."""
    return np.where(n >= edit_words, np.maximum(n // every, 1), 0)


class Lines:
    """The lines with words of a run of texts: document, number, word range and rolling hashes.

    whole: each text is one line, an empty one too.
    """

    def __init__(self, arr: pa.Array, whole: bool = False):
        w = Words(arr, lower=True)
        self.words = w
        start, end, self.doc = (w.off[:-1], w.off[1:], np.arange(w.n_docs)) if whole else w.lines()
        self.byte = start, end
        first_of = np.searchsorted(self.doc, np.arange(w.n_docs))
        self.number = np.arange(len(start)) - first_of[self.doc] if len(start) else np.zeros(0, np.int64)
        self.lo, self.hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        self.n = self.hi - self.lo
        k = len(w.hash)
        p = np.full(k + 1, _U(_ROLL))
        q = np.full(k + 1, _U(_ROLL_INV))
        p[0] = q[0] = 1
        self.p, self.q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        self.sum = np.zeros(k + 1, _U)
        np.cumsum(w.hash * self.p[:k], out=self.sum[1:])
        self.full = self.part(self.lo, self.hi)

    def raw(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Polynomial of the words lo .. hi, starting at power 0."""
        return (self.sum[hi] - self.sum[lo]) * self.q[lo]

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(self.raw(lo, hi) + (hi - lo).astype(_U))

    def halves(self, at: np.ndarray) -> list[np.ndarray]:
        """Keys of the halves of the given lines: for partners no longer, then for partners one word longer."""
        n, out = self.n[at], []
        for longer in (n, n + 1):
            q = longer // 2
            a, b = self.lo[at], self.hi[at]
            out.append(self.part(a, a + q) ^ _U(0x9D))
            out.append(self.part(b - q, b) ^ _U(0x55AA))
        return out

    def variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the given lines without each of their words, in order, and the places of these from 1."""
        n = self.n[at]
        k = blobs.ranges(self.lo[at], n)
        a, b = np.repeat(self.lo[at], n), np.repeat(self.hi[at], n)
        head = self.raw(a, k)
        tail = self.raw(k + 1, b) * self.p[k - a]
        return mix(head + tail + (b - a - 1).astype(_U)), k - a + 1

    def far(self, min_words: int, every: int) -> np.ndarray:
        """Lines that may have a partner more than one edit away."""
        return np.flatnonzero((self.n >= min_words) & (self.n * every // (every - 1) >= 2 * every))

    def windows(self, at: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the least windows of the given lines, and which of ``at`` each belongs to."""
        q = max(1, min(5, every // 4))
        m = self.n[at] - q + 1
        a = blobs.ranges(self.lo[at], m)
        # a line's windows by hash: one sort of numbers with the line on top; hashes of HASH bits only cost false candidates
        h = (np.repeat(np.arange(len(at), dtype=_U), m) << _U(HASH)) | (self.part(a, a + q) >> _U(64 - HASH))
        h.sort()
        who, h = (h >> _U(HASH)).astype(np.int64), h & _U((1 << HASH) - 1)
        k = np.arange(len(h))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        again = k - np.maximum.accumulate(np.where(new, k, 0))
        # the longest partner has n * every // (every - 1) words
        most = self.n[at] * every // (every - 1) // every * q + 1
        pick = k - np.repeat(np.cumsum(m) - m, m) < most[who]
        return mix(h[pick] + again[pick].astype(_U) * _U(_ROLL)) ^ _U(0x3C3C), who[pick]

    def histograms(self, at: np.ndarray) -> np.ndarray:
        """Counts of words by hash; a word edit changes them by 2 at most."""
        w = blobs.ranges(self.lo[at], self.n[at])
        cell = np.repeat(np.arange(len(at)), self.n[at]) * BINS + (self.words.hash[w] >> _U(60)).astype(np.int64)
        return np.minimum(np.bincount(cell, minlength=len(at) * BINS), 255).astype("u1").reshape(-1, BINS)


def _picked(arr: pa.Array, doc: np.ndarray, line: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Bytes of the lines of given numbers of given texts of a run, and which of those there are."""
    buf, off = flat(arr)
    nl = np.flatnonzero(buf == 10)
    before = np.searchsorted(nl, off)
    some = np.flatnonzero((line >= 0) & (line <= np.diff(before)[doc]) & (np.diff(off)[doc] > 0))
    d, k = doc[some], line[some].astype(np.int64)
    i = before[d] + k
    start = np.where(k > 0, np.append(nl, 0)[i - 1] + 1, off[d])
    end = np.where(i < before[d + 1], np.append(nl, 0)[i], off[d + 1])
    to = np.concatenate([[0], np.cumsum(end - start)])
    return pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(to), pa.py_buffer(buf[blobs.ranges(start, end - start)])]), some


def _once(x: np.ndarray) -> np.ndarray:
    """Ascending indices of one entry of each value."""
    return np.sort(np.unique(x, return_index=True)[1])


def _bucket(key: np.ndarray, p: int) -> np.ndarray:
    return (key % _U(p)).astype(np.uint16 if p <= 1 << 16 else np.int64)  # 16 bits are sorted by radix


def _earliest(key, doc, line, full):
    """First place of each key."""
    o = np.lexsort((line, doc, key))
    k = key[o]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(k)))
    return k[head], doc[o][head], line[o][head], n


def _spread(key, one, two):
    """Least and greatest line hash of each key."""
    if not len(key):
        return key, one, two
    o = np.argsort(key)
    k = key[o]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[head], np.minimum.reduceat(one[o], head), np.maximum.reduceat(two[o], head)


def _first_side(docs: DataFrame, p: int, min_words: int, edit_words: int, every: int) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact: list = []
        half: list = []
        wide: list = []
        size = 0

        def sent() -> pa.RecordBatch:
            key, doc, line, n = _earliest(*(np.concatenate(x) for x in zip(*exact, strict=True)))
            hk, lo, hi = _spread(*(np.concatenate(x) for x in zip(*half, strict=True)))
            wk, wl, m = (np.concatenate(x) for x in zip(*wide, strict=True))
            new = np.zeros(len(wl), bool)
            new[_once(wl)] = True  # equal lines have equal windows
            wk, wl = wk[np.repeat(new, m)], np.repeat(wl[new], m[new])
            o3, b3 = blobs.split(_bucket(wk, p), p)
            o1, b1 = blobs.split(_bucket(key, p), p)
            o2, b2 = blobs.split(_bucket(hk, p), p)
            out = []
            for k in range(p):
                x, y, z = o1[b1[k] : b1[k + 1]], o2[b2[k] : b2[k + 1]], o3[b3[k] : b3[k + 1]]
                out.append(blobs.pack(key[x], doc[x], line[x].astype("<u4"), np.minimum(n[x], 2).astype("u1"), hk[y], lo[y], hi[y], wk[z], wl[z]))
            return blobs.rows(list(range(p)), out)

        for b in it:
            ids, t = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            for i, j in runs(t):
                ln = Lines(t.slice(i, j - i))
                ok = np.flatnonzero(ln.n >= min_words)
                exact.append((ln.full[ok], ids[i:j][ln.doc[ok]], ln.number[ok], ln.full[ok]))
                ok = np.flatnonzero(ln.n >= max(edit_words - 1, min_words))
                ok = ok[_once(ln.full[ok])]
                h = ln.halves(ok)
                half.append((np.concatenate(h), np.tile(ln.full[ok], len(h)), np.tile(ln.full[ok], len(h))))
                ok = ln.far(min_words, every)
                ok = ok[_once(ln.full[ok])]
                key, who = ln.windows(ok, every)
                wide.append((key, ln.full[ok], np.bincount(who, minlength=len(ok))))
                size += len(exact[-1][0]) + len(h[0]) * len(h) + len(key)
                if size > 500_000:
                    yield sent()
                    exact, half, wide, size = [], [], [], 0
        if exact:
            yield sent()

    return blobs.exchange(docs.mapInArrow(work, blobs.SCHEMA), p)


def _second_side(sent: DataFrame) -> DataFrame:
    """kind 0: a repeated line with its first place; kinds 1 and 4: a half, a window of two or more different lines."""

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, doc, line, n, hk, lo, hi, wk, wl = blobs.gathered(parts)
        k1, d1, l1, m = _earliest(key, doc, line.astype(np.int64), None)
        many = np.unique(key[n > 1])
        keep = (m > 1) | np.isin(k1, many)
        k2, a, b = _spread(hk, lo, hi)
        k2 = k2[a != b]
        k3, a, b = _spread(wk, wl, wl)
        k3 = k3[a != b]
        z = int(keep.sum())
        kind = np.repeat([0, 1, 4], [z, len(k2), len(k3)]).astype(np.int32)
        pad = np.zeros(len(k2) + len(k3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([k1[keep], k2, k3]).view(np.int64)), pa.array(np.concatenate([d1[keep], pad])), pa.array(np.concatenate([l1[keep], pad]).astype(np.int32))], names=["kind", "key", "doc", "line"])

    return common.saved(blobs.by_partition(sent, work, "kind int, key bigint, doc bigint, line int"))


_RECORD = "kind int, key bigint, pos int, doc bigint, line int, full bigint, bins binary"


def _record(kind, key, pos, doc, line, full, bins=None) -> pa.RecordBatch:
    bins = pa.nulls(len(kind), pa.binary()) if bins is None else pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer((np.arange(len(bins) + 1) * BINS).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(bins))])
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int32)), pa.array(np.asarray(key, _U).view(np.int64)), pa.array(np.asarray(pos, np.int32)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(line, np.int32)), pa.array(np.asarray(full, _U).view(np.int64)), bins], names=["kind", "key", "pos", "doc", "line", "full", "bins"])


class _Packed:
    """Records of a kind, packed by ranges of their keys (pos: the range)."""

    def __init__(self, p: int, kind: int):
        self.p, self.kind, self.size = p, kind, 0
        self.have: list[tuple[np.ndarray, ...]] = []

    def sent(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size <= least:
            return
        key, pos, doc, line, full, *bins = (np.concatenate(x) for x in zip(*self.have, strict=True))
        self.have, self.size = [], 0
        order, b = blobs.split(_bucket(key, self.p), self.p)
        out = [(k, order[b[k] : b[k + 1]]) for k in range(self.p) if b[k + 1] > b[k]]
        n = len(out)
        packed = [blobs.pack(key[o], blobs.narrow(pos[o]), doc[o], blobs.narrow(line[o]), full[o], *(x[o].ravel() for x in bins)) for _, o in out]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.kind, np.int32)), pa.nulls(n, pa.int64()), pa.array([k for k, _ in out], pa.int32()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64())), pa.array(packed, pa.binary())], names=["kind", "key", "pos", "doc", "line", "full", "bins"])


class _Variants(_Packed):
    """kind 2: the variants (pos from 1) and the line itself (pos 0) of lines."""

    def __init__(self, p: int, edit_words: int):
        super().__init__(p, 2)
        self.edit_words = edit_words

    def add(self, ln: Lines, ids: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        long = at[ln.n[at] >= self.edit_words]
        key, pos = ln.variants(long)
        w = np.concatenate([at, np.repeat(long, ln.n[long])])
        self.have.append((np.concatenate([ln.full[at], key]), np.concatenate([np.zeros(len(at), np.int64), pos]), ids[ln.doc[w]], ln.number[w], ln.full[w]))
        self.size += len(w)


def _far(ln: Lines, ids: np.ndarray, at: np.ndarray, every: int, shared=None) -> tuple[np.ndarray, ...]:
    """The windows of the given lines: key, number of words, document, line, hash and histogram of the line."""
    key, who = ln.windows(at, every)
    if shared is not None:
        ok = shared(key)
        key, who = key[ok], who[ok]
    mine, who = np.unique(who, return_inverse=True)
    w = at[mine][who]
    return key, ln.n[w], ids[ln.doc[w]], ln.number[w], ln.full[w], ln.histograms(at[mine])[who]


WINDOWS = 100_000  # at most about, in a batch of packed ones


class _Windows(_Packed):
    """kind 5: the windows of lines (pos: number of words)."""

    def __init__(self, p: int):
        super().__init__(p, 5)

    def add(self, records: tuple[np.ndarray, ...]) -> None:
        if len(records[0]):
            self.have.append(records)
            self.size += len(records[0])


class _Keys:
    """Look-up in sorted hashes; a table of their high bits spares the search for most others."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(10, len(keys).bit_length() + 2)
        self.shift = _U(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[keys >> self.shift] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.some[x >> self.shift]
        if len(at := np.flatnonzero(out)):
            x = x[at]
            i = np.searchsorted(self.keys, x)
            i[i == len(self.keys)] = 0
            out[at] = self.keys[i] == x
        return out


def _looked_up(docs: DataFrame, found: DataFrame, p: int, min_words: int, edit_words: int, every: int) -> DataFrame:
    """Removed equal lines (kind 0) and the records of lines that share a half (kind 2) or a window (kind 5), by broadcast arrays."""
    sc = docs.sparkSession.sparkContext
    t = found.toArrow()
    kind = t["kind"].to_numpy()
    key = t["key"].to_numpy().view(_U)
    eq, hf = kind == 0, kind == 1
    o = np.argsort(key[eq])
    shared = sc.broadcast((key[eq][o], t["doc"].to_numpy()[eq][o], t["line"].to_numpy()[eq][o], np.sort(key[hf]), np.sort(key[kind == 4])))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ek, ed, el, hk, wk = shared.value
        halves, shares = _Keys(hk), _Keys(wk)
        variants, far = _Variants(p, edit_words), _Windows(p)
        for b in it:
            allids, t = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            for i, j in runs(t):
                ln, ids = Lines(t.slice(i, j - i)), allids[i:j]
                gone = np.zeros(len(ln.n), bool)
                if len(ek):
                    at = np.searchsorted(ek, ln.full)
                    at[at == len(ek)] = 0
                    hit = (ek[at] == ln.full) & (ln.n >= min_words)
                    gone = hit & ((ed[at] != ids[ln.doc]) | (el[at] != ln.number))
                    k = int(gone.sum())
                    yield _record(np.zeros(k), ln.full[gone], np.full(k, -2), ids[ln.doc[gone]], ln.number[gone], ln.full[gone])
                at = np.flatnonzero((ln.n >= max(edit_words - 1, min_words)) & ~gone)
                if len(at):
                    near = np.zeros(len(at), bool)
                    for h in ln.halves(at):
                        near |= halves.has(h)
                    variants.add(ln, ids, at[near])
                    yield from variants.sent(300_000)
                at = ln.far(min_words, every)
                if len(wk):
                    far.add(_far(ln, ids, at[~gone[at]], every, shares.has))
                    yield from far.sent(WINDOWS)
        yield from variants.sent(0)
        yield from far.sent(0)

    out = common.saved(docs.mapInArrow(work, _RECORD))
    shared.destroy()
    return out


def _joined(docs: DataFrame, found: DataFrame, p: int, min_words: int, edit_words: int, every: int) -> DataFrame:
    """The same records through joins, for key lists of any size."""

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            allids, t = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            for i, j in runs(t):
                ln, ids = Lines(t.slice(i, j - i)), allids[i:j]
                ok = np.flatnonzero(ln.n >= min_words)
                yield _record(np.zeros(len(ok)), ln.full[ok], np.full(len(ok), -2), ids[ln.doc[ok]], ln.number[ok], ln.full[ok])
                ok = np.flatnonzero(ln.n >= max(edit_words - 1, min_words))
                for h in ln.halves(ok):
                    yield _record(np.ones(len(ok)), h, np.full(len(ok), -2), ids[ln.doc[ok]], ln.number[ok], ln.full[ok])
                key, *rest = _far(ln, ids, ln.far(min_words, every), every)
                yield _record(np.full(len(key), 4), key, *rest)

    rows = docs.mapInArrow(keys, _RECORD)
    firsts = found.where("kind = 0").select("key", F.col("doc").alias("d0"), F.col("line").alias("l0"))
    gone = common.saved(rows.where("kind = 0").join(firsts, "key").where("doc <> d0 or line <> l0").select(*[F.col(c) for c in ("kind", "key", "pos", "doc", "line", "full", "bins")]))
    near = rows.where("kind = 1").join(found.where("kind = 1").select("key"), "key", "left_semi").select("doc", "line").distinct().join(gone.select("doc", "line"), ["doc", "line"], "left_anti")
    by_doc = near.groupBy(F.col("doc").alias("d")).agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def variants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Variants(p, edit_words)
        for b in it:
            allids, t, want = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1), b.column(2)
            for i, j in runs(t):
                ln = Lines(t.slice(i, j - i))
                begin = np.searchsorted(ln.doc, np.arange(j - i + 1))
                at = [begin[d] + x for d, xs in enumerate(want.slice(i, j - i).to_pylist()) for x in xs if x < begin[d + 1] - begin[d]]
                out.add(ln, allids[i:j], np.array(at, np.int64))
                yield from out.sent(300_000)
        yield from out.sent(0)

    far = rows.where("kind = 4").join(found.where("kind = 4").select("key"), "key", "left_semi").join(gone.select("doc", "line").distinct(), ["doc", "line"], "left_anti")

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Windows(p)
        for b in it:
            key, pos, doc, line, full = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            out.add((key.view(_U), pos, doc, line, full.view(_U), flat(b.column(6))[0].reshape(-1, BINS)))
            yield from out.sent(WINDOWS)
        yield from out.sent(0)

    far = far.select(*rows.columns).mapInArrow(windows, _RECORD)
    return common.saved(gone.unionByName(far).unionByName(docs.join(by_doc, F.col("id") == F.col("d")).select("id", "text", "lines").mapInArrow(variants, _RECORD)))


def _partners(rec: DataFrame, p: int) -> DataFrame:
    """For each line its earliest near line, if that is earlier: (doc, line, full, pdoc, pline)."""
    shape = "doc bigint, line int, full bigint, pdoc bigint, pline int"

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, pos, doc, line, full = blobs.gathered(parts)
        o = np.lexsort((line, doc))
        d, n = doc[o], line[o].astype(np.int64)
        new = np.ones(len(o), bool)
        new[1:] = (d[1:] != d[:-1]) | (n[1:] != n[:-1])
        rank = np.empty(len(o), np.int64)
        rank[o] = np.cumsum(new) - 1
        places = o[new]  # a record of each place
        del d, n, new
        o = np.lexsort((rank, pos, key))
        key, pos, rank = key[o], pos[o], rank[o]
        by_key = np.ones(len(o), bool)
        by_key[1:] = key[1:] != key[:-1]
        by_pos = by_key.copy()
        by_pos[1:] |= pos[1:] != pos[:-1]
        of_key, of_pos = np.cumsum(by_key) - 1, np.cumsum(by_pos) - 1
        head = np.flatnonzero(by_key)
        least, first = np.minimum.reduceat(rank, head), rank[by_pos]
        own = np.where(pos[head] == 0, rank[head], len(places))
        cand = np.where(pos == 0, least[of_key], np.minimum(first[of_pos], own[of_key]))
        ok = np.flatnonzero(cand < rank)
        ok = ok[np.lexsort((cand[ok], rank[ok]))]
        r = rank[ok]
        ok = ok[np.concatenate([[True], r[1:] != r[:-1]])] if len(ok) else ok
        mine, other = places[rank[ok]], places[cand[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(doc[mine]), pa.array(line[mine].astype(np.int32)), pa.array(full[mine].view(np.int64)), pa.array(doc[other]), pa.array(line[other].astype(np.int32))], names=["doc", "line", "full", "pdoc", "pline"])

    sent = blobs.exchange(rec.select(F.col("pos").alias("bucket"), F.col("bins").alias("blob")), p)
    got = blobs.by_partition(sent, work, shape)
    return got.groupBy("doc", "line", "full").agg(F.min(F.struct("pdoc", "pline")).alias("c")).select("doc", "line", "full", "c.pdoc", "c.pline")


PAIRS = 100_000  # compared at once; their histograms take about 100 bytes each
_PAIRS = "doc bigint, line int, full bigint, pdoc bigint, pline int"


def _near(key, n, doc, line, full, bins, done, first: bool, edit_words: int, every: int) -> Iterator[pa.RecordBatch]:
    """Of records by key, document and line: those of lines not done with earlier ones of their key that may be near."""
    k = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, k, 0))
    todo = np.flatnonzero(~done & (k - head > (not first)))
    start, count = (head[todo], np.ones(len(todo), np.int64)) if first else (head[todo] + 1, (k - head)[todo] - 1)
    total = np.cumsum(count)
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        x, y = np.repeat(todo[i:j], count[i:j]), blobs.ranges(start[i:j], count[i:j])
        most = np.maximum(n[x], n[y])
        allowed = bound(most, edit_words, every)
        ok = (most >= 2 * every) & (np.abs(n[x] - n[y]) <= allowed) & ((doc[x] != doc[y]) | (line[x] != line[y]))
        x, y, allowed = x[ok], y[ok], allowed[ok]
        ok = np.abs(bins[x].astype(np.int16) - bins[y]).sum(1) <= 2 * allowed
        x, y = x[ok], y[ok]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[x], line[x], full[x], doc[y], line[y])], names=["doc", "line", "full", "pdoc", "pline"])
        i = j


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of places."""
    return mix(doc.astype(np.int64).view(_U) + mix(line.astype(_U) + _U(_ROLL)))


def _unpacked(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    key, n, doc, line, full, bins = blobs.gathered(parts)
    return key, n.astype(np.int32), doc, line.astype(np.int32), full.view(np.int64), bins.reshape(-1, BINS)


def _window_rows(packed: DataFrame) -> DataFrame:
    """Records of kind 5 as such of kind 4."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in b.column(0).to_pylist():
                key, n, doc, line, full, bins = _unpacked([blobs.unpack(x)])
                yield _record(np.full(len(key), 4), key, n, doc, line, full.view(_U), bins)

    return packed.select("bins").mapInArrow(work, _RECORD)


def _pairs(packed: DataFrame, done: DataFrame, first: bool, p: int, edit_words: int, every: int, lookup_keys: int) -> DataFrame:
    """Lines not done with earlier lines that share a window with them and may be near: the earliest of each window, or all others."""
    done = done.select("doc", "line").distinct()
    if done.count() > lookup_keys:
        return common.saved(_joined_pairs(_window_rows(packed), done, first, edit_words, every))
    t = done.toArrow()
    shared = done.sparkSession.sparkContext.broadcast(np.sort(_place(t["doc"].to_numpy(), t["line"].to_numpy())))

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, n, doc, line, full, bins = _unpacked(parts)
        o = np.lexsort((line, doc, key))
        key, n, doc, line, full, bins = (x[o] for x in (key, n, doc, line, full, bins))
        yield from _near(key, n, doc, line, full, bins, _Keys(shared.value).has(_place(doc, line)), first, edit_words, every)

    out = common.saved(blobs.by_partition(blobs.exchange(packed.select(F.col("pos").alias("bucket"), F.col("bins").alias("blob")), p), work, _PAIRS).distinct())
    shared.destroy()
    return out


def _joined_pairs(rows: DataFrame, done: DataFrame, first: bool, edit_words: int, every: int) -> DataFrame:
    """The same through joins, for any number of lines done."""
    flag = done.withColumn("done", F.lit(True))
    t = rows.join(common.small(flag, 16), ["doc", "line"], "left").select("key", "pos", "doc", "line", "full", "bins", F.col("done").isNotNull().alias("done"))

    def pairs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, n, doc, line, full = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        yield from _near(key, n, doc, line, full, flat(b.column(5))[0].reshape(-1, BINS), b.column(6).to_numpy(zero_copy_only=False), first, edit_words, every)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in it:  # rows come by key; the last key's wait for the next batch
            key = b.column(0).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if kept and (cut or kept[0].column(0)[0].as_py() != key[0]):
                whole = pa.Table.from_batches([*kept, b.slice(0, cut)]).combine_chunks().to_batches()
                yield from pairs(whole[0])
                kept = []
            elif cut:
                yield from pairs(b.slice(0, cut))
            kept.append(b.slice(cut))
        if kept:
            yield from pairs(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return t.repartition("key").sortWithinPartitions("key", "doc", "line").mapInArrow(work, _PAIRS).distinct()


STRIDES = 1, 4, 16, 64  # words compared at once: most diagonals end at the first, the others go on for long


def _flat(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(v) for v in x], np.int64)
    return np.concatenate([*x, np.zeros(STRIDES[-1], _U)]), np.cumsum(n) - n, n


def within(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Whether at most k edits turn one sequence into the other, for each pair: furthest places on 2k + 1 diagonals."""
    aw, a0, na = _flat(a)
    bw, b0, nb = _flat(b)
    d = np.arange(-k - 1, k + 2)
    most = np.minimum(na[:, None], nb[:, None] - d)
    out = np.zeros(len(a), bool)
    none = np.iinfo(np.int64).min // 2
    f = np.full(most.shape, none)
    f[:, k + 1] = 0
    rest = np.flatnonzero(np.abs(na - nb) <= k)
    f, most = f[rest], most[rest]
    for e in range(k + 1):
        if e:
            g = f.copy()
            g[:, 1:-1] = np.maximum(np.maximum(f[:, 1:-1], f[:, 2:]) + 1, f[:, :-2])
            g = np.minimum(g, most)
            g[(g < 0) | (g + d < 0)] = none
            g[:, [0, -1]] = none
            f = g
        p, c = np.nonzero((f >= 0) & (f < most))
        turn = 0
        while len(p):
            step = np.arange(STRIDES[min(turn, len(STRIDES) - 1)])
            i = f[p, c]
            same = aw[(a0[rest[p]] + i)[:, None] + step] == bw[(b0[rest[p]] + i + d[c])[:, None] + step]
            whole = same.all(1)
            i = np.minimum(i + np.where(whole, len(step), same.argmin(1)), most[p, c])
            f[p, c] = i
            more = whole & (i < most[p, c])
            p, c = p[more], c[more]
            turn += 1
        done = f[np.arange(len(rest)), k + 1 + (nb - na)[rest]] >= na[rest]
        out[rest[done]] = True
        rest, f, most = rest[~done], f[~done], most[~done]
        if not len(rest):
            break
    return out


def _check(docs: DataFrame, pairs: DataFrame, edit_words: int, every: int) -> DataFrame:
    """The pairs whose fetched lines are near."""
    need = pairs.select("doc", "line").unionByName(pairs.select(F.col("pdoc").alias("doc"), F.col("pline").alias("line"))).distinct()
    need = common.saved(need.groupBy(F.col("doc").alias("d")).agg(F.collect_list("line").alias("lines")))

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, t, want = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1), b.column(2)
            for i, j in runs(t):
                xs = want.slice(i, j - i)
                doc, line = pc.list_parent_indices(xs).to_numpy(), pc.list_flatten(xs).to_numpy()
                part, some = _picked(t.slice(i, j - i), doc, line)
                w = Words(part, lower=True)
                words = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(w.first.astype(np.int64) * 8), pa.py_buffer(w.hash)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc[some]]), pa.array(line[some].astype(np.int32)), words.cast(pa.binary())], names=["doc", "line", "words"])

    side = common.small(need, 40, items="lines", item_bytes=4)
    words = common.saved(docs.join(side, F.col("id") == F.col("d")).select("id", "text", "lines").mapInArrow(fetch, "doc bigint, line int, words binary"))
    j = pairs.join(words, ["doc", "line"]).join(words.select(F.col("doc").alias("pdoc"), F.col("line").alias("pline"), F.col("words").alias("pwords")), ["pdoc", "pline"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = ([np.frombuffer(v, _U) for v in b.column(c).to_pylist()] for c in (3, 4))
            allowed = bound(np.array([max(len(u), len(v)) for u, v in zip(x, y, strict=True)], np.int64), edit_words, every)
            ok = np.zeros(len(x), bool)
            for k in np.unique(allowed).tolist():
                at = np.flatnonzero(allowed == k)
                step = max(1, 60_000 // (2 * k + 3))
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    ok[part] = within([x[v] for v in part], [y[v] for v in part], k)
            yield b.filter(pa.array(ok, pa.bool_())).select(["doc", "line", "full"])

    return j.select("doc", "line", "full", "words", "pwords").mapInArrow(verify, "doc bigint, line int, full bigint").distinct()


def removals(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, lookup_keys: int = LOOKUP_KEYS, edit_every: int = EDIT_EVERY) -> DataFrame:
    """One row per document with removed lines: d, gone (array of line number and line hash)."""
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null and id is not null")
    p = common.buckets_for(df, 12 << 20)
    found = _second_side(_first_side(docs, p, min_words, edit_words, edit_every))
    rec = (_looked_up if found.count() <= lookup_keys else _joined)(docs, found, p, min_words, edit_words, edit_every)
    near = _check(docs, common.saved(_partners(rec.where("kind = 2"), p)), edit_words, edit_every)
    far = rec.where("kind = 5")
    if far.limit(1).count():  # only an existence check
        near = common.saved(near)
        for first in (True, False):
            pairs = _pairs(far, near, first, p, edit_words, edit_every, lookup_keys)
            near = common.saved(near.unionByName(_check(docs, pairs, edit_words, edit_every)))
    gone = rec.where("kind = 0").select("doc", "line", "full").unionByName(near)
    return common.saved(gone.groupBy(F.col("doc").alias("d")).agg(F.collect_set(F.struct("line", "full")).alias("gone")))


def _rebuilt(df: DataFrame, id_col: str, text: str, gone: DataFrame, schema: str, make) -> DataFrame:
    side = common.small(gone, 40, items="gone", item_bytes=32)
    pre = "__lines_"
    j = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], F.col(f"`{id_col}`").cast("bigint").alias(pre + "id"), F.col(f"`{text}`").cast("string").alias(pre + "text"))
    j = j.join(side, F.col(pre + "id") == F.col("d"), "left")
    own = len(df.columns)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t, g = b.column(own + 1), b.column(b.num_columns - 1)
            for i, j in runs(t):
                part, gone = t.slice(i, j - i), g.slice(i, j - i)
                count = np.where(pc.fill_null(pc.binary_length(part), 0).to_numpy() > 0, pc.fill_null(pc.count_substring(part, "\n"), 0).to_numpy() + 1, 0)
                doc, each = pc.list_parent_indices(gone).to_numpy(), pc.list_flatten(gone)
                line, full = each.field("line").to_numpy(), each.field("full").to_numpy()
                lines, some = _picked(part, doc, line)  # of the texts only these lines are read
                ok = np.flatnonzero(Lines(lines, whole=True).full.view(np.int64) == full[some])
                ok = ok[np.lexsort((line[some[ok]], doc[some[ok]]))]
                chars = pc.utf8_length(lines.view(pa.large_string())).to_numpy()
                yield make(b.slice(i, j - i), part, count, doc[some[ok]].astype(np.int64), line[some[ok]], chars[ok])

    return j.mapInArrow(work, schema)


def _without(text: str, lines: list[int]) -> str:
    drop = set(lines)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", drop_empty: bool = False, **options) -> DataFrame:
    """The rows with their removed lines taken out; ``drop_empty`` drops rows that lost every line."""
    gone = removals(df, id_col, text, **options)
    at = df.columns.index(text)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def make(b, part, count, doc, line, chars):
        arrays = [b.column(k) for k in range(len(df_columns))]
        n = np.bincount(doc, minlength=len(part))
        some, end = np.flatnonzero(n), np.cumsum(n)
        texts = [_without(part[d].as_py(), line[end[d] - n[d] : end[d]].tolist()) for d in some.tolist()]
        arrays[at] = pc.replace_with_mask(part, pa.array(n > 0), pa.array(texts, pa.string())) if len(some) else part
        out = pa.RecordBatch.from_arrays(arrays, names=df_columns)
        return out.filter(pa.array((n == 0) | (n < count))) if drop_empty and len(some) else out

    df_columns = list(df.columns)
    return _rebuilt(df, id_col, text, gone, schema, make)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, removed line numbers (from 0), n_kept_chars."""
    df = common.documents(spark, sf_dir).select("doc_id", "text")
    gone = removals(df)

    def make(b, part, count, doc, line, chars):
        n = np.bincount(doc, minlength=len(part))
        less = np.bincount(doc, chars + 1, len(part)).astype(np.int64)  # each line goes with a line end, the last that is left has none
        kept = np.where((n > 0) & (n == count), 0, pc.fill_null(pc.utf8_length(part), 0).to_numpy() - less)
        removed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(line.astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int64)), removed, pa.array(kept.astype(np.int64))], names=["doc_id", "n_lines", "removed", "n_kept_chars"])

    return _rebuilt(df, "doc_id", "text", gone, "doc_id bigint, n_lines bigint, removed array<int>, n_kept_chars bigint", make)
