"""Exact n-gram Jaccard join by universe partition and pigeonhole.

Two sets link when den * |r & s| >= num * |r | s|; then their difference has at most
H = (1 - t) / (1 + t) * (|r| + |s|) elements, t = num / den.

1. Universe: distinct shingles are counted over all sets through a columnar shuffle of
   sorted, delta-coded hashes.  A shingle of one set is in every difference of that set,
   so u of them lower its bound to H - u; sets with too few shared shingles end here.
2. Partition: the shared universe falls into segments.  Shingles of few sets are
   segments of their own (cheap to index); more frequent ones are hashed into segments
   sized by the set's size band.  Segments have one global order, rarest tier first.
3. Allocation: a set indexes segments in that order until their values exceed its
   bound, or only its cheap single shingles if these exceed what it may have alone.  A
   single shingle is worth 1 (subset only); a larger subset is worth 2 and is
   indexed with its one-deletion neighbourhood.  If the first of two sets to stop has
   spent more than the difference, some indexed segment differs by less than its value,
   and the other set has indexed it too, so the pair meets.
4. Sets whose segments cannot exceed the bound index everything and are also matched
   among themselves on every shingle of a prefix.
5. Verification compares whole sets.  Pairs go to blocks around a shared neighbour, a
   large block is cut in two dimensions, and a set is sent to each block once.

Large families of near texts would make as many pairs as the square of their size.  A set
that links with a listed centre belongs to the centre's family (the first such one); two
sets of one family never meet in the index, their links are counted from how each differs
from the centre (``_Kin``).  Which centres are listed changes the cost, not the result.

Equal sets are one class throughout.  Exactness rests on 64-bit hashes not colliding, and
in a pair to verify on hashes of 22 bits more than number all shingles.

Null and empty texts have no set, link with nothing and are their own component.
Repeated rows with one id count as that many documents. Rows without an id link with
nothing and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import blobs, common, graph
from lumenframe.llm.textvec import Words, mix, mix_int, runs, sorted_distinct

_U = np.uint64
HOT_KEEP = 4096  # hot candidates kept by each batch for the corpus-wide count
HOT_SHARE = 0.002  # a shingle in more than this share of rows is hot
HOT_LEAST = 256
LOW_DF = 64  # shingles in at most this many sets are segments of their own
TOP_TIER = 60
SKETCH = 3  # least index keys that travel with a set
RUN = 4096  # sets that share a key and are compared in one task
SLICE = 4 << 20  # text bytes of a slice
BUCKET_SHINGLES = 2_000_000
SHARES = 10_000
KIN_LEAST = 64  # classes with a least hash in common that make a family
CENTRES, CENTRE_SHINGLES = 4096, 1_000_000  # of the largest families, at most; other pairs go through the index
KIN_BLOCK = 32_768  # classes of a family for each task that counts its links
BAND, FILL = 8, 3.0  # sizes of a band differ by this factor; mean shingles in a segment at its top


def shingle_sets(arr: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text, and a 64-bit key of each set."""
    w = Words(arr, lower=True)
    at, doc, h = w.windows(n)
    first = np.searchsorted(doc, np.arange(w.n_docs + 1))
    count = np.diff(w.first)
    sets, keys = [], np.zeros(w.n_docs, _U)
    for d in range(w.n_docs):
        if count[d] >= n:
            s = sorted_distinct(h[first[d] : first[d + 1]])
        elif count[d]:
            x = mix_int(count[d] + 0x51ED270B)
            for y in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix_int(x * 0x9E3779B1 + int(y))
            s = np.array([x], _U)
        else:
            s = np.zeros(0, _U)
        sets.append(s)
        if len(s):
            keys[d] = mix_int(int(mix(s).sum(dtype=_U)) * 0x9E3779B97F4A7C15 + len(s))
    return sets, keys


#: Odd factors permute hashes; the least product of a set is its sketch in one slot.
_SLOTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], _U)
_LEAST = ["m0", "m1", "m2"]


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """High halves of the least product in each slot, a row a set; empty sets get zeros."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), len(_SLOTS)), np.int32)
    if size.sum():
        tok = np.concatenate(sets)
        full = size > 0
        head = (np.cumsum(size) - size)[full]
        for k, f in enumerate(_SLOTS):
            out[full, k] = (np.minimum.reduceat(tok * f, head) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


class _Kin:
    """Families around centres.

    With d the size of a set's difference D from the centre and
    w = (den + num) * d - (den - num) * size, two sets of a family link if and only if
    w + w' <= 2 * (den + num) * |D & D'|: their difference has d + d' - 2 * |D & D'|
    elements.  Pairs with w + w' <= 0 link by their weights alone; in all others one set
    has w > 0, so only for those sets the common parts are counted, over lists of the sets
    that each element is in.
    """

    def __init__(self, centres: list[np.ndarray], num: int, den: int):
        self.centres, self.num, self.den = centres, num, den
        least = least_hashes(centres)
        self.order = np.argsort(least, axis=0, kind="stable")
        self.least = np.take_along_axis(least, self.order, 0)

    def _near(self, least: np.ndarray) -> dict[int, set[int]]:
        """By row, the centres with a least hash in common."""
        near: dict[int, set[int]] = {}
        for k in range(least.shape[1] if self.centres else 0):
            a, b = (np.searchsorted(self.least[:, k], least[:, k], side) for side in ("left", "right"))
            for i in np.flatnonzero(b > a).tolist():
                near.setdefault(i, set()).update(self.order[a[i] : b[i], k].tolist())
        return near

    def maybe(self, least: np.ndarray) -> np.ndarray:
        """Rows that may belong to a family."""
        return np.array(sorted(self._near(least)), np.int64)

    def families(self, sets: list[np.ndarray]) -> np.ndarray:
        """Number of each set's family, from 1; 0: none."""
        out = np.zeros(len(sets), np.int64)
        if self.centres:
            for i, some in self._near(least_hashes(sets)).items():
                for c in sorted(some) if len(sets[i]) else ():
                    r, s = sets[i], self.centres[c]
                    if (self.den + self.num) * len(np.setxor1d(r, s, True)) <= (self.den - self.num) * (len(r) + len(s)):
                        out[i] = c + 1
                        break
        return out

    def counts(self, key: np.ndarray, copies: np.ndarray, size: np.ndarray, parts: list[np.ndarray], block: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the copies of other sets that each set links with, as far as this block counts them."""
        both, d = self.den + self.num, np.array([len(x) for x in parts], np.int64)
        w = both * d - (self.den - self.num) * size
        o = np.argsort(w, kind="stable")
        key, copies, d, w = key[o], copies[o], d[o], w[o]
        other = np.zeros(len(key), np.int64)
        if block == 0:
            upto = np.append(0, np.cumsum(copies))
            other += upto[np.searchsorted(w, -w, "right")] - np.where(w <= 0, copies, 0)
        mine = np.flatnonzero((w > 0) & (key % cut == block))
        if len(mine):
            _, item = np.unique(np.concatenate([parts[i] for i in o]), return_inverse=True)
            ends = np.cumsum(d)
            by = np.argsort(item, kind="stable")
            owner = np.repeat(np.arange(len(key)), d)[by]
            n = np.bincount(item)
            begin = np.cumsum(n) - n
            for r in mine.tolist():  # with the sets before it, of no more weight
                i = int(np.searchsorted(w, -w[r], "right"))
                e = item[ends[r] - d[r] : ends[r]]
                common_ = np.bincount(owner[blobs.ranges(begin[e], n[e])], minlength=len(key))[i:r]
                ok = i + np.flatnonzero(w[i:r] + w[r] <= 2 * both * common_)
                other[r] += copies[ok].sum()
                other[ok] += copies[r]
        return key, other


def _set_rows(df: DataFrame, n: int) -> list[tuple[int, np.ndarray]]:
    """(set key, shingles) of (text) rows; for a few rows."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in runs(b.column(0)):
                sets, keys = shingle_sets(b.column(0).slice(i, j - i), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "s"])

    return [(r.key, np.frombuffer(r.s, _U)) for r in df.mapInArrow(work, "key bigint, s binary").collect()]


def _centres(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> tuple[_Kin, list[int]]:
    """Centres of the largest families and their keys: of the classes that share a least hash with many the one with the most copies."""
    slots = classes.select("key", "copies", F.posexplode(F.array(*_LEAST)).alias("slot", "m"))
    top = common.saved(slots.groupBy("slot", "m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= KIN_LEAST).orderBy(F.desc("k"), "slot", "m").limit(CENTRES))
    found = slots.join(F.broadcast(top), ["slot", "m"]).groupBy("slot", "m").agg(F.max("k").alias("k"), F.max(F.struct("copies", "key")).alias("c")).groupBy(F.col("c.key").alias("key")).agg(F.max("k").alias("k"))
    rows = found.join(classes, "key").select("key", "k", "n", "rep").orderBy(F.desc("k"), "key").collect() if top.limit(1).count() else []
    most = np.searchsorted(np.cumsum([r.n for r in rows]), CENTRE_SHINGLES, "right")
    rows = rows[:most]
    if not rows:
        return _Kin([], num, den), []
    reps = docs.sparkSession.createDataFrame([(r.rep,) for r in rows], "rep bigint").distinct()
    sets = dict(_set_rows(docs.join(F.broadcast(reps), docs["id"] == reps["rep"]).select("text"), n))
    return _Kin([sets[r.key] for r in rows], num, den), [r.key for r in rows]


def _kin_side(docs: DataFrame, classes: DataFrame, kin: _Kin, keys: list[int], n: int, p: int, width: int) -> DataFrame:
    """(key, centre, other): the classes of families, and the copies of other classes of their family that they link with."""
    spark, block_size = docs.sparkSession, KIN_BLOCK
    shape = "key bigint, centre bigint, other bigint"
    if not keys:
        return spark.createDataFrame([], shape)

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = kin.maybe(np.stack([b.column(3 + k).to_numpy() for k in range(len(_LEAST))], 1))
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at)) for k in range(3)], names=["key", "rep", "copies"])

    wanted = common.saved(classes.select("key", "rep", "copies", *_LEAST).mapInArrow(pick, "key bigint, rep bigint, copies bigint"))
    # rows that share an id: a text of another key is another class's
    texts = docs.join(common.small(wanted, 32), docs["id"] == wanted["rep"]).select("key", "copies", "text")

    def differ(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = b.column(2)
            for i, j in runs(t):
                sets, own = shingle_sets(t.slice(i, j - i), n)
                family = kin.families(sets)
                family[own.view(np.int64) != b.column(0).slice(i, j - i).to_numpy()] = 0
                at = np.flatnonzero(family)
                parts = [blobs.pack(_bytes(np.diff(np.setxor1d(sets[k], kin.centres[family[k] - 1], True) >> _U(64 - width), prepend=_U(0)))) for k in at]
                rows = pa.array(i + at)
                yield pa.RecordBatch.from_arrays([pa.array(family[at].astype(np.int32)), b.column(0).take(rows), b.column(1).take(rows), pa.array([len(sets[k]) for k in at], pa.int64()), pa.array(parts, pa.binary())], names=["family", "key", "copies", "n", "d"])

    rows = common.saved(texts.mapInArrow(differ, "family int, key bigint, copies bigint, n bigint, d binary"))
    cuts = F.broadcast(rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("cut")))
    placed = rows.join(cuts, "family").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select("family", "block", "cut", "key", "copies", "n", "d")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, dict] = {}
        for b in it:
            family, block, cut, key, copies, size, d = (c.to_pylist() for c in b.columns)
            for i in range(len(key)):  # rows that share an id and a text come more than once
                by.setdefault((family[i], block[i], cut[i]), {})[key[i]] = copies[i], size[i], d[i]
        for (family, block, cut), x in by.items():
            copies, size = (np.array([v[k] for v in x.values()], np.int64) for k in (0, 1))
            key, other = kin.counts(np.fromiter(x, np.int64, len(x)), copies, size, [np.cumsum(_number(blobs.unpack(v[2])[0]), dtype=_U) for v in x.values()], block, cut)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), keys[family - 1], np.int64)), pa.array(other)], names=["key", "centre", "other"])

    return common.saved(placed.repartition(p, "family", "block").mapInArrow(count, shape).groupBy("key", "centre").agg(F.sum("other").alias("other")))


def _members(df: DataFrame, n: int) -> DataFrame:
    """kind 0: (id, set key, set size, least hashes) of each row; kind 1: (shingle, rows) of frequent shingles of a batch."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, t = b.column(0), b.column(1)
            for i, j in runs(t, SLICE):
                sets, keys, low = [], [], []
                for x, y in runs(t.slice(i, j - i)):
                    part = shingle_sets(t.slice(i + x, y - x), n)
                    sets += part[0]
                    keys.append(part[1])
                    low.append(least_hashes(part[0]))
                keys, low = np.concatenate(keys), np.concatenate(low)
                size = np.array([len(s) for s in sets], np.int64)
                every = np.sort(np.concatenate(sets)) if size.sum() else np.zeros(0, _U)
                begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
                c = np.diff(np.append(begin, len(every)))
                top = np.argsort(c, kind="stable")[-HOT_KEEP:]
                top = top[c[top] > 1]
                k, m = j - i, len(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [k, m]).astype(np.int32)), pa.concat_arrays([ids.slice(i, k).cast(pa.int64()), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([keys, every[begin[top]]]).view(np.int64)), pa.array(np.concatenate([size, c[top]])), *(pa.concat_arrays([pa.array(x), pa.nulls(m, pa.int32())]) for x in low.T.copy())],
                    names=["kind", "id", "key", "n", *_LEAST],
                )

    return common.saved(df.select("id", "text").mapInArrow(work, "kind int, id bigint, key bigint, n bigint" + "".join(f", {m} int" for m in _LEAST)))


def _coded(y: np.ndarray, owner: np.ndarray, bits: int, base: int) -> np.ndarray:
    """Ascending numbers, as steps from ``base``, with their owners in the low ``bits`` bits, in as few bytes as the largest needs."""
    step = np.diff(y, prepend=_U(base))
    return _bytes((step << _U(bits)) | owner.astype(_U))


def _bytes(v: np.ndarray) -> np.ndarray:
    width = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    return blobs.cut(v << _U(64 - 8 * width), width)


def _number(v: np.ndarray) -> np.ndarray:
    width = v.dtype.itemsize
    return blobs.uncut(v, width) >> _U(64 - 8 * width)


def _decoded(v: np.ndarray, bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    x = _number(v)
    return _U(base) + np.cumsum(x >> _U(bits), dtype=_U), (x & _U((1 << bits) - 1)).astype(np.int64)


def _starts(p: int, width: int) -> np.ndarray:
    """First number of each of p ranges of the ``width``-bit numbers."""
    return np.array([-(-(k << width) // p) for k in range(p)], _U)


def _count_side(df: DataFrame, n: int, p: int, width: int, hot: np.ndarray, kin: _Kin) -> DataFrame:
    """The distinct sets of each slice of texts, their shingles by ranges of the hash.

    A slice sends a range its shingles in ascending order, each with its set's number in
    the slice, so a shingle costs the same few bytes whatever the number of ranges.  Sets'
    keys go along, by their hash, so that of equal sets in several slices one is chosen.
    What the slice needs again (keys, sizes, hot shingles, families) passes through one range to it.
    A slice is known by a hash of its sets and its place.
    """
    starts = _starts(p, width)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for b in it:
            t = b.column(0)
            for i, j in runs(t, SLICE):
                by_key: dict[int, np.ndarray] = {}
                for x, y in runs(t.slice(i, j - i)):
                    sets, keys = shingle_sets(t.slice(i + x, y - x), n)
                    by_key.update((int(k), s) for k, s in zip(keys, sets, strict=True) if len(s))
                if not by_key:
                    continue
                keys = np.fromiter(by_key, _U, len(by_key))
                size = np.array([len(s) for s in by_key.values()], np.int64)
                family = kin.families(list(by_key.values()))
                tok = np.concatenate(list(by_key.values()))
                by_key = {}
                owner = np.repeat(np.arange(len(keys), dtype="<u4"), size)
                hot_owner = hot_at = np.zeros(0, np.int64)
                if len(hot):
                    at = np.searchsorted(hot, tok)
                    at[at == len(hot)] = 0
                    known = hot[at] == tok
                    hot_owner, hot_at = owner[known], at[known]
                    tok, owner = tok[~known], owner[~known]
                bits = max(1, int(len(keys) - 1).bit_length())
                x = ((tok >> _U(64 - width)) << _U(bits)) | owner
                del tok, owner
                x.sort()
                bounds = np.append(np.searchsorted(x, starts << _U(bits)), len(x))
                own, x = x & _U((1 << bits) - 1), x >> _U(bits)
                name = mix_int(int(mix(keys).sum(dtype=_U)) ^ mix_int(task << 32 | nth))
                nth += 1
                home = name % p
                korder, kb = blobs.split((mix(keys) % _U(p)).astype(np.int64), p)
                out, bucket = [], []
                for k in range(p):
                    o, h = slice(bounds[k], bounds[k + 1]), korder[kb[k] : kb[k + 1]]
                    if bounds[k + 1] > bounds[k] or len(h) or k == home:
                        mine = (keys, blobs.narrow(size), blobs.narrow(hot_owner), blobs.narrow(hot_at), blobs.narrow(family)) if k == home else (keys[:0],) * 5
                        out.append(blobs.pack(np.array([name, bits, starts[k]], _U), _coded(x[o], own[o], bits, int(starts[k])), keys[h], blobs.narrow(h), *mine))
                        bucket.append(k)
                yield blobs.rows(bucket, out)

    return blobs.exchange(df.select("text").mapInArrow(work, blobs.SCHEMA), p)


def _tier_side(counted: DataFrame, p: int, width: int, hot: np.ndarray, hot_tier: np.ndarray) -> DataFrame:
    """Counts sets by shingle and returns to each slice its shared shingles, with a cost tier, and which of its sets another slice has too.

    Copies of a set in several slices count each: tiers only order shingles, and a shingle
    that one class alone has then merely looks shared.
    """
    short = hot >> _U(64 - width)

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([_decoded(x[1], int(x[0][1]), int(x[0][2]))[0] for x in parts])
        every.sort()
        head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        df = np.diff(np.append(head, len(every)))
        shared = every[head]
        del every, head
        tier = np.minimum(np.ceil(np.log2(np.maximum(df, 1))), TOP_TIER).astype("u1")
        if len(short) and len(shared):
            at = np.searchsorted(short, shared)
            at[at == len(short)] = 0
            tier = np.where(short[at] == shared, hot_tier[at], tier).astype("u1")
        shared, tier = shared[tier > 0], tier[tier > 0]
        key = np.concatenate([x[2] for x in parts])
        whose = np.repeat(np.arange(len(parts)), [len(x[2]) for x in parts])
        slices = np.array([x[0][0] for x in parts], _U)
        o = np.lexsort((slices[whose], key))
        again = np.zeros(len(key), bool)
        again[o[1:]] = key[o[1:]] == key[o[:-1]]
        first = np.concatenate([[0], np.cumsum([len(x[2]) for x in parts])])
        for i, x in enumerate(parts):
            name, bits, base = (int(v) for v in x[0])
            tok, own = _decoded(x[1], bits, base)
            at = np.searchsorted(shared, tok)
            at[at == len(shared)] = 0
            ok = np.flatnonzero(shared[at] == tok) if len(shared) else np.zeros(0, np.int64)
            yield blobs.rows([name % p], [blobs.pack(np.array([name, bits, base, len(tok)], _U), _coded(tok[ok], own[ok], bits, base), tier[at[ok]] if len(ok) else tier[:0], x[3][again[first[i] : first[i + 1]]], *x[4:])])

    return blobs.exchange(blobs.by_partition(counted, work, blobs.SCHEMA), p)


def _band(size: int) -> int:
    return int(math.log(size, BAND) + 1e-9)


def signatures(tok: np.ndarray, tier: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, given its shared shingles, their tiers and its whole size.

    With each key goes twice the value of the segments before its own in the order, plus
    one for a key of the second sort, which is not a single cheap shingle.
    """
    none = np.zeros(0, _U), np.zeros(0, np.int64)
    unique = size - len(tok)
    if len(tok) * den < num * size:
        return none
    most = size * den // num  # the largest partner
    bound = (den - num) * (size + most) // (den + num) - unique
    if bound < 0:
        return none
    cheap = tier <= math.ceil(math.log2(LOW_DF))
    low = tok[cheap]
    low = low[np.lexsort((low, tier[cheap]))]
    # a single shingle's segment differs only if the partner lacks it, so here the one-sided bound counts
    alone = size - (num * size + den - 1) // den - unique
    if len(low) > alone:
        return mix(low[: alone + 1]), np.arange(alone + 1) * 2
    out, before = [mix(low)], [np.arange(len(low)) * 2]
    spent = len(low)
    rest, rtier = tok[~cheap].astype(_U), tier[~cheap]
    for band in range(_band(size), _band(most) + 1):
        m = max(1, int(BAND ** (band + 1) / FILL))
        seg = (rtier.astype(_U) << _U(56)) | ((mix(rest ^ _U(0x5E61)) % _U(m)) << _U(8)) | _U(band)
        order = np.lexsort((rest, seg))
        g, e = seg[order], mix(rest[order])
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        k = np.diff(np.append(head, len(g)))
        value = np.where(k >= 2, 2, 1)
        total = spent + np.cumsum(value)
        stop = min(len(head), int(np.searchsorted(total, bound + 1)) + 1)
        if len(head):
            full = np.add.reduceat(e, head)[:stop]
            at = (total - value)[:stop]
            k, head = k[:stop], head[:stop]
            out.append(mix(full + mix(g[head])))
            before.append(at * 2 + 1)
            n = int(k.sum())
            seg_of = np.repeat(np.arange(len(head)), k)
            many = k[seg_of] >= 2
            out.append(mix(full[seg_of][many] - e[:n][many] + mix(g[:n][many])))
            before.append(at[seg_of][many] * 2 + 1)
        if not len(total) or total[-1] <= bound:
            # the bound cannot be exceeded: match on a plain prefix among such sets, and by every segment with the others
            prefix = np.lexsort((tok, tier))[: size - (num * size + den - 1) // den + 1 - unique]
            out.append(mix(mix(tok[prefix]) ^ _U(0x0DDBA11)))
            before.append(np.ones(len(prefix), np.int64))
    sig, at = np.concatenate(out), np.concatenate(before)
    o = np.lexsort((at, sig))
    sig, at = sig[o], at[o]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    return sig[first], at[first]


def _signature_side(tiers: DataFrame, q: int, width: int, reach: int, hot: np.ndarray, hot_tier: np.ndarray, num: int, den: int) -> DataFrame:
    """The index: ``reach``-bit keys in ascending order by ranges, each with its set."""
    starts = _starts(q, reach)
    short = hot >> _U(64 - width)
    most = (1 << reach) - 1

    def entries(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The index entries of one slice's sets."""
        mine = [x for x in parts if len(x[4])]
        if len(mine) != 1:
            raise RuntimeError("a slice's sets did not arrive")
        keys, size, hot_owner, hot_at, family = mine[0][4], *(x.astype(np.int64) for x in mine[0][5:9])
        if sum(int(x[0][3]) for x in parts) + len(hot_owner) != size.sum():
            raise RuntimeError("a slice's shingles did not arrive")
        got = [_decoded(x[1], int(x[0][1]), int(x[0][2])) for x in parts]
        tok = np.concatenate([short[hot_at], *(g[0] for g in got)])
        own = np.concatenate([hot_owner, *(g[1] for g in got)]).astype("<u4")
        tier = np.concatenate([hot_tier[hot_at], *(x[2] for x in parts)])
        del got
        order = np.argsort(own, kind="stable")
        tok, tier = tok[order], tier[order]
        bounds = np.searchsorted(own[order], np.arange(len(keys) + 1))
        del own, order
        lone = size - np.diff(bounds)
        todo = np.diff(bounds) * den >= num * size
        for x in parts:
            todo[x[3]] = False
        sigs, spent, whose = [], [], []
        sketch, sat = np.full((len(keys), SKETCH), _U(most)), np.zeros((len(keys), SKETCH), np.int64)
        for c in np.flatnonzero(todo):
            s, at = signatures(tok[bounds[c] : bounds[c + 1]], tier[bounds[c] : bounds[c + 1]], int(size[c]), num, den)
            if len(s):
                s = s >> _U(64 - reach)
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                if len(new) < len(s):
                    s, at = s[new], np.minimum.reduceat(at, new)
                sketch[c, : min(len(s), SKETCH)], sat[c, : min(len(s), SKETCH)] = s[:SKETCH], at[:SKETCH]
                sigs.append(s)
                spent.append(at)
                whose.append(np.full(len(s), c, "<u4"))
        if not sigs:
            return
        sig, at, own = np.concatenate(sigs), np.concatenate(spent), np.concatenate(whose)
        order = np.argsort(sig)
        sig, at, own = sig[order], at[order], own[order]
        b = np.append(np.searchsorted(sig, starts), len(sig))
        for k in range(q):
            o = slice(b[k], b[k + 1])
            if b[k + 1] > b[k]:
                which, here = np.unique(own[o], return_inverse=True)
                bits = max(1, int(len(which) - 1).bit_length())
                yield blobs.rows([k], [blobs.pack(np.array([bits, starts[k], k], _U), _coded(sig[o], here, bits, int(starts[k])), blobs.narrow(at[o]), keys[which], blobs.narrow(size[which]), blobs.narrow(lone[which]), _bytes(sketch[which].ravel()), blobs.narrow(sat[which].ravel()), blobs.narrow(family[which]))])

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for x in parts:
            by.setdefault(int(x[0][0]), []).append(x)
        parts.clear()
        for name in sorted(by):
            yield from entries(by.pop(name))

    return blobs.exchange(blobs.by_partition(tiers, work, blobs.SCHEMA), q)


class _Heads:
    """The sets that an index range knows, and the rules by which two of them are a pair to verify."""

    def __init__(self, key, size, lone, sketch, sat, family, here: int, q: int, reach: int, num: int, den: int):
        self.key, self.size, self.lone = key, size.astype(np.int64), lone.astype(np.int64)
        self.sketch, self.sat = sketch.reshape(-1, SKETCH), sat.reshape(-1, SKETCH).astype(np.int64)
        self.family = family.astype(np.int64)
        self.here, self.q, self.reach, self.num, self.den = here, q, reach, num, den

    def reached(self, a, b, at_a, at_b):
        """Whether both sets spend no more before a key than the pair may differ by."""
        num, den, total = self.num, self.den, self.size[a] + self.size[b]
        most = (den - num) * total // (den + num) - self.lone[a] - self.lone[b]
        share = -(-num * total // (den + num))
        one, two = self.size[a] - share - self.lone[a], self.size[b] - share - self.lone[b]
        second = (at_a & 1) == 1
        return (most >= 0) & (at_a // 2 <= np.where(second, most, one)) & (at_b // 2 <= np.where(second, most, two))

    def met(self, a, b, at_a, at_b) -> np.ndarray:
        """Pairs that may link, of sets that are not of one family, as sorted distinct numbers."""
        ok = np.flatnonzero(((self.family[a] != self.family[b]) | (self.family[a] == 0)) & (self.den * np.minimum(self.size[a], self.size[b]) >= self.num * np.maximum(self.size[a], self.size[b])) & (a != b))
        ok = ok[self.reached(a[ok], b[ok], at_a[ok], at_b[ok])]
        a, b = a[ok].astype(_U), b[ok].astype(_U)
        return sorted_distinct((np.minimum(a, b) << _U(32)) | np.maximum(a, b))

    def reported(self, seen: np.ndarray) -> pa.RecordBatch:
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        none = _U((1 << self.reach) - 1)
        for k in range(0, len(seen), 500_000):
            a, b = (seen[k : k + 500_000] >> _U(32)).astype(np.int64), (seen[k : k + 500_000] & _U(0xFFFFFFFF)).astype(np.int64)
            least = np.full(len(a), none)
            for u in range(SKETCH):
                for v in range(SKETCH):
                    x = self.sketch[a, u]
                    i = np.flatnonzero((x == self.sketch[b, v]) & (x < least))
                    i = i[self.reached(a[i], b[i], self.sat[a[i], u], self.sat[b[i], v])]
                    least[i] = x[i]
            mine = (least == none) | ((least * _U(self.q)) >> _U(self.reach) == _U(self.here))
            x, y = self.key[a[mine]].view(np.int64), self.key[b[mine]].view(np.int64)
            xs.append(np.minimum(x, y))
            ys.append(np.maximum(x, y))
        return _found(np.concatenate(xs), np.concatenate(ys))


_FOUND = "a bigint, b bigint, bucket int, blob binary"


def _found(a, b, bucket=(), blob=()) -> pa.RecordBatch:
    """Pairs, then blocks of pairs that other tasks compare."""
    n, m = len(a), len(bucket)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (a, b)] + [pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(bucket, pa.int32())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(blob, pa.binary())])], names=["a", "b", "bucket", "blob"])


def _pair_side(indexed: DataFrame, q: int, reach: int, num: int, den: int) -> DataFrame:
    """Pairs of classes that meet in the index and whose sizes allow a link.

    Two sizes fix the pair's own bound, less the shingles that each set has alone; a key
    counts only if both sets reach it within that bound.  Similar sets meet in many
    ranges: each carries its SKETCH least keys, and if two share one that counts, only
    the range of the least such key reports the pair.  A key that more than RUN sets share,
    with more pairs than RUN sets have, is not compared here: blocks of two parts of the
    sets go to tasks of their own.  Sets of one family stand together, and each set is
    compared with those after its family.
    """

    run = RUN

    def work(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        here = int(parts[0][0][2])
        sig, own, at, before = [], [], [], 0
        for x in parts:
            s, o = _decoded(x[1], int(x[0][0]), int(x[0][1]))
            sig.append(s)
            own.append((o + before).astype("<u4"))
            at.append(x[2].astype("<u4"))
            before += len(x[3])
        heads = _Heads(*(np.concatenate([f(x[k]) for x in parts]) for k, f in ((3, np.asarray), (4, np.asarray), (5, np.asarray), (6, _number), (7, np.asarray), (8, np.asarray))), here, q, reach, num, den)
        parts.clear()
        sig, own, at = np.concatenate(sig), np.concatenate(own), np.concatenate(at)
        order = np.lexsort((heads.family[own], sig))
        sig, own, at = sig[order], own[order].astype(np.int64), at[order].astype(np.int64)
        del order
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        n = np.diff(np.append(head, len(sig)))
        kind = heads.family[own]
        last = np.flatnonzero(np.append((sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0), True)) + 1
        after = np.repeat(last, np.diff(last, prepend=0))  # where the next family, or set of none, begins
        del kind, last
        reach_ = np.repeat(head + n, n) - after
        big = (n > run) & (np.add.reduceat(reach_, head) > run * (run - 1) // 2)
        for h, k in zip(head[big].tolist(), n[big].tolist(), strict=True):
            o = h + np.argsort(heads.size[own[h : h + k]], kind="stable")
            yield from _blocks(heads, own[o], at[o], int(sig[h]), run // 2)
        many = np.flatnonzero((reach_ > 0) & np.repeat(~big, n))
        if not len(many):
            return
        reach_, after = reach_[many], after[many]
        cum = np.cumsum(reach_)
        most, i = 1_000_000, 0
        seen = np.zeros(0, _U)
        while i < len(many):  # about ``most`` pairs at a time
            j = max(i + 1, int(np.searchsorted(cum, (cum[i - 1] if i else 0) + most, "right")))
            r = reach_[i:j]
            x, y = np.repeat(many[i:j], r), blobs.ranges(after[i:j], r)
            seen = sorted_distinct(np.concatenate([seen, heads.met(own[x], own[y], at[x], at[y])]))
            if len(seen) > 4 * most:
                yield heads.reported(seen)
                seen = seen[:0]
            i = j
        if len(seen):
            yield heads.reported(seen)

    return blobs.by_partition(indexed, work, _FOUND)


def _blocks(heads: _Heads, own: np.ndarray, at: np.ndarray, sig: int, step: int) -> Iterator[pa.RecordBatch]:
    """The sets of one key, by size, in parts of ``step``: every two parts whose sizes allow a link."""
    cuts = range(0, len(own), step)
    size = heads.size[own]
    for i in cuts:
        for j in cuts:
            if i <= j and heads.den * int(size[min(i + step, len(own)) - 1]) >= heads.num * int(size[j]):
                o = np.concatenate([np.arange(i, min(i + step, len(own))), np.arange(j, min(j + step, len(own))) if j > i else np.zeros(0, np.int64)])
                w = own[o]
                blob = blobs.pack(np.array([heads.here, min(i + step, len(own)) - i], _U), blobs.narrow(at[o]), heads.key[w], blobs.narrow(heads.size[w]), blobs.narrow(heads.lone[w]), heads.sketch[w].ravel(), blobs.narrow(heads.sat[w].ravel()), blobs.narrow(heads.family[w]))
                yield _found((), (), [mix_int(sig ^ mix_int(i * 0x10001 + j)) % heads.q], [blob])


def _block_side(blocks: DataFrame, q: int, reach: int, num: int, den: int) -> DataFrame:
    """The pairs of all blocks, a block at a time."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for blob in b.column(1):
                (here, half), at, *rest = blobs.unpack(blob.as_py())
                heads = _Heads(*rest, int(here), q, reach, num, den)
                at, n, half = at.astype(np.int64), len(at), int(half)
                for i in range(0, half, 256):
                    x, y = np.meshgrid(np.arange(i, min(i + 256, half)), np.arange(half, n) if n > half else np.arange(n), indexing="ij")
                    x, y = x.ravel(), y.ravel()
                    if n == half:
                        x, y = x[x < y], y[x < y]
                    seen = heads.met(x, y, at[x], at[y])
                    if len(seen):
                        yield heads.reported(seen)

    return blobs.exchange(blocks.select("bucket", "blob"), q).mapInArrow(work, _FOUND).select("a", "b")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, p: int, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets link; ``width`` bits tell the shingles of two sets apart."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = common.saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    few = label.count()
    lab = pairs.join(common.small(label.select("a", F.col("label").alias("la")), 32, few), "a").join(common.small(label.select(F.col("a").alias("b"), F.col("label").alias("lb")), 32, few), "b").withColumn("label", F.least("la", "lb"))
    cuts = common.small(lab.groupBy("label").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / 100_000)).alias("cut")), 32, few)
    cell = lambda c: F.pmod(F.xxhash64(c), "cut")
    placed = common.saved(lab.join(cuts, "label").select("a", "b", F.xxhash64("label", cell("a"), cell("b")).alias("block")))
    need = placed.select("block", F.col("a").alias("key")).unionByName(placed.select("block", F.col("b").alias("key"))).distinct()
    need = common.saved(need.groupBy("key").agg(F.collect_set("block").alias("blocks")).join(classes.select("key", "rep"), "key"))
    rows = need.count()

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = b.column(2)
            for i, j in runs(t):
                s, keys = shingle_sets(t.slice(i, j - i), n)
                out = [(blk, int(k), blobs.pack(_bytes(np.diff(x >> _U(64 - width), prepend=_U(0))))) for blks, k, x in zip(b.column(1).slice(i, j - i).to_pylist(), keys.view(np.int64), s, strict=True) for blk in blks]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.nulls(len(out), pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["block", "a", "b", "s"])

    wanted = common.small(need.select("rep", "key", "blocks"), 64, rows)
    texts = docs.join(wanted, docs["id"] == wanted["rep"]).select("key", "blocks", "text")
    shape = "block bigint, a bigint, b bigint, s binary"
    moved = texts.mapInArrow(sets, shape).unionByName(placed.select("block", "a", "b", F.lit(None).cast("binary").alias("s")))

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        ask: list[tuple[np.ndarray, np.ndarray]] = []
        for b in it:
            s = b.column(3)
            isset = s.is_valid().to_numpy(zero_copy_only=False)
            a = b.column(1).to_numpy()
            for i in np.flatnonzero(isset):
                have[int(a[i])] = np.cumsum(_number(blobs.unpack(s[int(i)].as_py())[0]), dtype=_U)
            if not isset.all():
                ask.append((a[~isset], b.column(2).filter(pa.array(~isset)).to_numpy()))
        good = ([], [])
        for x, y in ask:
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                r, s = have.get(u), have.get(v)
                if r is None or s is None:
                    raise RuntimeError("a set to verify did not arrive")
                if len(r) > len(s):
                    r, s = s, r
                at = np.searchsorted(s, r)
                at[at == len(s)] = 0
                both = int((s[at] == r).sum())
                if den * both >= num * (len(r) + len(s) - both):
                    good[0].append(u)
                    good[1].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(good[0], pa.int64()), pa.array(good[1], pa.int64())], names=["a", "b"])

    return common.saved(moved.repartition(p, "block").mapInArrow(verify, "a bigint, b bigint"))


def links(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 2, num: int = 60, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (id, key, n), classes (key, n, rep, copies), links (a, b) between different classes that are not of one family, and families (key, centre, other)."""
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    both = _members(docs, n)
    members = both.where("kind = 0").select("id", "key", "n")
    docs = docs.where("id is not null")
    classes = common.saved(both.where("kind = 0 and n > 0 and id is not null").groupBy("key").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(m).alias(m) for m in _LEAST)))
    total, shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(HOT_LEAST, HOT_SHARE * total)
    # at most mean set size / HOT_SHARE shingles can reach the share, so this list is bounded
    found = both.where("kind = 1").groupBy("key").agg(F.sum("n").alias("c")).where(F.col("c") >= least).orderBy("key").toArrow()
    hot = found["key"].to_numpy().view(_U)
    tier = np.minimum(np.ceil(np.log2(np.maximum(found["c"].to_numpy(), 2))), TOP_TIER).astype("u1")
    o = np.argsort(hot)
    hot, tier = hot[o], tier[o]
    p = max(4, -(-int(shingles) // BUCKET_SHINGLES))
    # wide enough for the shingles' number: rare false matches only make a shingle look shared, or two keys one
    need = math.ceil(math.log2(max(2, shingles)))
    width, reach = min(44, max(24, need + 7)), min(44, max(24, need + 10))
    kin, centres = _centres(docs, classes, n, num, den)
    exact = min(64, need + 22)
    families = _kin_side(docs, classes, kin, centres, n, p, exact)
    sent = _count_side(docs, n, p, width, hot, kin)
    q = max(2, p // 4)  # fewer ranges report a pair of similar sets less often
    indexed = _signature_side(_tier_side(sent, p, width, hot, tier), q, width, reach, hot, tier, num, den)
    met = common.saved(_pair_side(indexed, q, reach, num, den).distinct())
    del sent, indexed
    common.release(df.sparkSession)
    pairs = met.where("a is not null").select("a", "b")
    blocks = met.where("blob is not null")
    if blocks.limit(1).count():  # only an existence check
        pairs = common.saved(pairs.unionByName(_block_side(blocks, q, reach, num, den)).distinct())
    return members, classes, _verified(docs, classes, pairs, n, p, exact, num, den), families


def groups(members: DataFrame, classes: DataFrame, found: DataFrame, families: DataFrame) -> DataFrame:
    """Per document: id, key and root of its set, n_shingles, n_similar and the smallest id reachable by links."""
    sides = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = common.small(classes.select(F.col("key").alias("b"), "copies"), 32)
    other = sides.join(copies, "b").select(F.col("a").alias("key"), F.col("copies").alias("other")).unionByName(families.select("key", "other")).groupBy("key").agg(F.sum("other").alias("other"))
    near = found.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(families.select(F.col("key").alias("u"), F.col("centre").alias("v")))
    roots = graph.components(near).withColumnRenamed("node", "key")
    c = classes.join(other, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = c.groupBy("root").agg(F.min("rep").alias("component_id"))
    c = common.saved(c.join(least, "root").select("key", "root", "copies", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_similar"), "component_id"))
    # a class with a large share of all rows is looked up in a list of at most SHARES classes, so its rows stay where they are
    large = F.broadcast(c.where(F.col("copies") * SHARES > F.lit(members.count())).select("key", "root", "n_similar", "component_id"))
    some = members.where("n > 0 and id is not null")
    rest = c.select("key", "root", "n_similar", "component_id")
    linked = some.join(large, "key").unionByName(some.join(large.select("key"), "key", "left_anti").join(rest, "key"))
    alone = members.where("not (n > 0 and id is not null)").select("key", "id", "n", F.col("key").alias("root"), F.lit(0).alias("n_similar"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", "key", "root", F.col("n").alias("n_shingles"), F.col("n_similar").cast("bigint").alias("n_similar"), "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 2, num: int = 60, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, n_similar, component_id."""
    return groups(*links(df, id_col, text, n, num, den)).drop("key", "root").withColumnRenamed("id", id_col)


def _keyed(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """The rows, their columns named by place, with ``id``, ``key`` and ``n`` of their sets."""
    k = len(df.columns)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "".join(f"c{i} {t}, " for i, (_, t) in enumerate(df.dtypes)) + "id bigint, key bigint, n bigint"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in runs(b.column(k + 1)):
                part = b.slice(i, j - i)
                sets, keys = shingle_sets(part.column(k + 1), n)
                yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64())], names=[*part.schema.names[: k + 1], "key", "n"])

    return rows.mapInArrow(work, schema)


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 2, num: int = 60, den: int = 100) -> DataFrame:
    """One row of each group of linked documents, the one of the smallest id (then set key); its own columns only.

    Rows without words or without an id are linked with nothing and stay.  Where rows share an
    id, id and set tell them apart, so rows of one id and different texts are judged each on
    its own; of rows with equal id and equal set one stays.
    """
    g = common.saved(groups(*links(df, id_col, text, n, num, den)))
    linked = g.where("n_shingles > 0 and id is not null")
    if not linked.groupBy("id").count().where("count > 1").limit(1).count():  # only an existence check
        gone = linked.where("component_id <> id").select(F.col("id").alias("__gone"))
        return df.join(common.small(gone, 16), F.col(f"`{id_col}`").cast("bigint") == F.col("__gone"), "left_anti")
    first = linked.groupBy("root").agg(F.min(F.struct("id", "key")).alias("f")).select("f.id", "f.key")
    rows = _keyed(df, id_col, text, n)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    loose = F.col("id").isNull() | (F.col("n") == 0)
    kept = rows.where(~loose).join(first, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return rows.where(loose).select(*own).unionByName(kept.select(*own))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
