"""Language ID: interpolated Kneser-Ney character models, one a language.

Characters: letters, lowered, fall into 63 classes (a-z their own, others by hash); every
run of other characters is one space.  Contexts at the start of a text are spaces.  A
4-gram is then a 24-bit key, so a model has at most 2**24 entries whatever the corpus,
and may be broadcast.  Counting covers all training texts: tasks send sorted keys with
counts in packed blobs, which buckets of the key space add up.  The probabilities of all
4-grams seen in any language lie in one array sorted by key, a column a language, so one
binary search a character scores every language; the rest backs off to trigrams.  More than
``MAX_LANGUAGES`` languages are scored in groups of so many: the texts go through one
group's broadcast after another, and their cross-entropies are put side by side.

The language with the lowest cross-entropy per character is chosen.  A bounded sample of
the labelled rows of each language (about ``calibration_rows`` shared out evenly, or
``LEAST_ROWS``, but a fifth of its rows at most), which is not counted for the models, sets the temperature of the score and, per
language, the cross-entropy beyond which a text is rejected, wider for short texts.
Languages with fewer than 20 rightly predicted rows take spread and limit from the rows of
all; if these are fewer than 20 too, nothing with letters is rejected.

Defined cases: null texts and texts without letters are ``und`` with score 0 and
rejected; without any training text every text is ``und``, and only those are rejected;
ties go to the language that sorts first; rows without a language do not train.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import blobs, common
from lumenframe.llm.textvec import flat, runs

#: Texts are scanned in runs of about this many bytes; arrays beside them take some 100 bytes a character.
SCAN_BYTES = 1 << 18
ORDER, BITS = 4, 6
CLASSES = 1 << BITS
MAX_LANGUAGES = 128
CALIBRATION_ROWS = 20_000
LEAST_ROWS = 200
SCALE = 2.0 ** np.arange(0, 9)
PARTS = 16
#: A text is rejected beyond this quantile of the calibration rows' standardised cross-entropy, times the margin.
QUANTILE, MARGIN = 0.999, 2.0
CALIBRATION_SHARE = 0.2  # of a language's rows at most


@cache
def _table() -> np.ndarray:
    """Class of each code point; 0 is a space."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = ord(x.lower()[0])
            out[c] = y - 96 if 97 <= y <= 122 else 27 + (y * 2654435761 >> 12) % (CLASSES - 27)
    return out


def slices(arr: pa.Array) -> Iterator[tuple[int, int]]:
    return runs(arr, SCAN_BYTES)


def grams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all texts one after another, their bounds, and which texts have a letter."""
    buf, off = flat(arr)
    k = len(off) - 1
    cps = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    at = lead[off]
    cls = _table()[cps]
    prev = np.empty_like(cls)
    if len(cls):
        prev[0], prev[1:] = 0, cls[:-1]
        prev[at[:-1][at[:-1] < len(cls)]] = 0
    keep = (cls != 0) | (prev != 0)
    kept = np.zeros(len(cls) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    bound = kept[at]
    c = cls[keep].astype(np.uint32)
    n = np.diff(bound)
    pad = ORDER - 1
    full = np.zeros(len(c) + pad * (k + 1), np.uint32)
    where = np.arange(len(c)) + pad * (np.repeat(np.arange(k), n) + 1)
    full[where] = c
    key = full[where]
    for i in range(1, ORDER):
        key = key | (full[where - i] << np.uint32(BITS * i))
    letters = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c != 0, out=letters[1:])
    return key, bound, letters[bound[1:]] > letters[bound[:-1]]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(counts[o], head) if len(k) else counts


def count(train: DataFrame, lang: str, text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """4-gram keys and counts of each language over all rows with a language and a text."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for name, parts in sorted(have.items()):
                k, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                b = np.searchsorted(k, np.arange(PARTS + 1) << (ORDER * BITS - 4))
                yield blobs.rows(list(range(PARTS)), [blobs.pack(np.frombuffer(name.encode(), "u1"), k[b[i] : b[i + 1]].astype("<u4"), n[b[i] : b[i + 1]].astype("<i8")) for i in range(PARTS)])

        for batch in it:
            langs, t = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            for i, j in slices(t):
                key, bound, _ = grams(t.slice(i, j - i))
                who = np.repeat(np.arange(j - i), np.diff(bound))
                for name in sorted(set(langs[i:j])):
                    mine = np.sort(key[(langs[i:j] == name)[who]])
                    head = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
                    if len(head):
                        have.setdefault(name, []).append((mine[head], np.diff(np.append(head, len(mine))).astype(np.int64)))
                        size += len(head)
                if size > 800_000:
                    have = {k: [_summed(np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v]))] for k, v in have.items()}
                    size = sum(len(v[0][0]) for v in have.values())
                    if size > 500_000:
                        yield from sent()
                        have, size = {}, 0
        yield from sent()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bytes, list] = {}
        for b in it:
            for x in b.column(1).to_pylist():
                name, k, n = blobs.unpack(x)
                got.setdefault(name.tobytes(), []).append((k, n))
        for name, parts in sorted(got.items()):
            k, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([name.decode()]), pa.array([blobs.pack(k, n)], pa.binary())], names=["lang", "blob"])

    rows = train.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    # at most 2**24 keys a language come to the driver
    out: dict[str, list] = {}
    for r in blobs.exchange(rows.mapInArrow(work, blobs.SCHEMA), PARTS).mapInArrow(add, "lang string, blob binary").collect():
        out.setdefault(r.lang, []).append(blobs.unpack(bytes(r.blob)))
    return {k: _summed(np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v])) for k, v in sorted(out.items()) if any(len(p[0]) for p in v)}


def _discount(c: np.ndarray) -> float:
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _level(keys: np.ndarray, c: np.ndarray, order: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense probabilities of an order up to 3 from its (continuation) counts, and the back-off weight of each context."""
    size = 1 << (BITS * order)
    ctx = keys >> BITS
    m = size >> BITS
    total = np.bincount(ctx, c, m)
    kinds = np.bincount(ctx, minlength=m)
    d = _discount(c)
    gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    p = np.repeat(gamma, CLASSES) * np.tile(lower, size // len(lower))
    p[keys] += np.maximum(c - d, 0) / total[ctx]
    return p, gamma


class Model:
    """Kneser-Ney models of all languages over one sorted key array."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = list(counts)
        n = len(self.langs)
        self.keys = np.unique(np.concatenate([k for k, _ in counts.values()])) if n else np.zeros(0, np.uint32)
        self.logp = np.zeros((len(self.keys), n), np.float32)
        self.gamma = np.zeros((1 << (BITS * 3), n), np.float32)
        self.tri = np.zeros((1 << (BITS * 3), n), np.float32)
        for i, (k, c) in enumerate(counts.values()):
            k = k.astype(np.int64)
            tri, ctri = np.unique(k & ((1 << 18) - 1), return_counts=True)
            bi, cbi = np.unique(tri & ((1 << 12) - 1), return_counts=True)
            uni, cuni = np.unique(bi & (CLASSES - 1), return_counts=True)
            p1, _ = _level(uni, cuni, 1, np.full(CLASSES, 1 / CLASSES))
            p2, _ = _level(bi, cbi, 2, p1)
            p3, _ = _level(tri, ctri, 3, p2)
            d = _discount(c)
            total = np.bincount(k >> BITS, c, 1 << 18)
            kinds = np.bincount(k >> BITS, minlength=1 << 18)
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            u = self.keys.astype(np.int64)
            p = gamma[u >> BITS] * p3[u & ((1 << 18) - 1)]
            p[np.searchsorted(u, k)] += np.maximum(c - d, 0) / total[k >> BITS]
            self.logp[:, i] = np.log2(p)
            self.gamma[:, i] = np.log2(gamma)
            self.tri[:, i] = np.log2(p3)

    def entropies(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, characters, and whether a letter occurs."""
        key, bound, letter = grams(arr)
        n = np.diff(bound)
        if not len(key) or not self.langs:
            return np.zeros((len(n), len(self.langs))), n, letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        lp = self.logp[at]
        miss = np.flatnonzero(self.keys[at] != key)
        lp[miss] = self.gamma[key[miss] >> BITS] + self.tri[key[miss] & ((1 << 18) - 1)]
        some = np.flatnonzero(n)
        h = np.zeros((len(n), len(self.langs)))
        h[some] = -np.add.reduceat(lp, bound[:-1][some], axis=0, dtype=np.float64) / n[some, None]
        return h, n, letter

    def judge(self, h: np.ndarray, n: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy under the true language, whether it is the least, and the loss at each temperature."""
        at = np.arange(len(h))
        loss = np.stack([-np.log(np.maximum(self._score(h, n, t)[at, truth], 1e-12)) for t in SCALE], 1)
        return h[at, truth], h.argmin(1) == truth, loss

    def calibrate(self, own: np.ndarray, right: np.ndarray, loss: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Temperature of the score; centre, spread and limit of each language's cross-entropy."""
        self.temperature = float(SCALE[int(np.argmin(loss.mean(0)))]) if len(own) else 1.0
        k = len(self.langs)
        self.centre, self.spread, self.limit = np.zeros(k), np.ones(k), np.full(k, np.inf)
        if right.sum() < 20:
            return
        own, n, truth = own[right], n[right], truth[right]
        self.centre[:] = np.median(own)
        for i in np.unique(truth):
            self.centre[i] = np.median(own[truth == i])
        dev = (own - self.centre[truth]) / self._width(n)
        for i in range(k):
            mine = truth == i
            x = dev[mine] if mine.sum() >= 20 else dev
            self.spread[i] = max(np.median(np.abs(x)) * 1.4826, 1e-3)
            self.limit[i] = MARGIN * max(np.quantile(x / self.spread[i], QUANTILE), 6.0)

    @staticmethod
    def _width(n: np.ndarray) -> np.ndarray:
        return np.sqrt(1 / 2000 + 1 / np.maximum(n, 1))

    @staticmethod
    def _score(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
        x = -h * np.log(2) * n[:, None] / temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def predict(self, arr: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        return self.decide(*self.entropies(arr))

    def decide(self, h: np.ndarray, n: np.ndarray, letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), ~letter
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        score = np.where(letter, self._score(h, n, self.temperature)[np.arange(len(h)), best], 0.0)
        z = (least - self.centre[best]) / self._width(n) / self.spread[best]
        return [self.langs[b] if x else "und" for b, x in zip(best, letter, strict=True)], score, least, ~letter | (z > self.limit[best])


class Grouped(Model):
    """Models of more languages than one broadcast holds; each group's is built when it is needed."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], most: int):
        self.langs, self.counts, self.most = list(counts), counts, most

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "counts"}

    def groups(self) -> Iterator[Model]:
        for i in range(0, len(self.langs), self.most):
            yield Model({x: self.counts[x] for x in self.langs[i : i + self.most]})

    def entropies(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [m.entropies(arr) for m in self.groups()]
        return np.concatenate([h for h, _, _ in got], 1), *got[0][1:]

    def scored(self, df: DataFrame) -> DataFrame:
        """The rows with __n, __letter and __h, one cross-entropy a language; the last column is the text."""
        k = len(df.columns)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", `__n` bigint, `__letter` boolean, `__h` array<double>"
        for m in self.groups():
            shared = df.sparkSession.sparkContext.broadcast(m)

            def work(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for b in it:
                    for i, j in slices(b.column(k - 1)):
                        part = b.slice(i, j - i)
                        h, n, letter = shared.value.entropies(part.column(k - 1))
                        if part.num_columns > k:
                            h = np.concatenate([part.column(k + 2).flatten().to_numpy().reshape(len(n), -1), h], 1)
                        h = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * h.shape[1], h.ravel())
                        yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(n, pa.int64()), pa.array(letter), h], names=[*part.schema.names[:k], "__n", "__letter", "__h"])

            # written, so that no worker holds two groups
            df = common.saved(df.mapInArrow(work, schema))
            shared.unpersist()
        return df


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", calibration_rows: int = CALIBRATION_ROWS, most: int | None = None) -> Model:
    """Trains on the rows with a language and a text, but for a bounded number of each language's that, by a hash, calibrate."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    bound = max(calibration_rows // max(len(per), 1), LEAST_ROWS)
    share = [(k, int(min(CALIBRATION_SHARE, bound / n) * (1 << 40))) for k, n in per.items()]
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    split = rows.join(common.small(df.sparkSession.createDataFrame(share, "lang string, share bigint"), 64, rows=len(share)), "lang").withColumn("calibrates", F.coalesce(hashed < F.col("share"), F.lit(False)))
    counts = count(split.where("not calibrates"), "lang", "text")
    most = most or MAX_LANGUAGES
    grouped = len(counts) > most
    model = Grouped(counts, most) if grouped else Model(counts)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = {x: i for i, x in enumerate(model.langs)}
        for b in it:
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                if grouped:
                    h = part.column(4).flatten().to_numpy().reshape(j - i, -1)
                    n, letter = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                else:
                    h, n, letter = model.entropies(part.column(1))
                truth = np.array([names[x] for x in part.column(0).to_pylist()])[letter]
                own, right, loss = model.judge(h[letter], n[letter], truth)
                yield pa.RecordBatch.from_arrays([pa.array(truth, pa.int32()), pa.array(n[letter], pa.int64()), pa.array(own), pa.array(right), pa.array(list(loss), pa.list_(pa.float64()))], names=["truth", "n", "own", "right", "loss"])

    picked = split.where("calibrates").where(F.col("lang").isin(model.langs)).select("lang", "text")
    t = (model.scored(picked) if grouped else picked).mapInArrow(work, "truth int, n bigint, own double, right boolean, loss array<double>").toArrow()
    own, right, n, truth = (t[c].to_numpy() for c in ("own", "right", "n", "truth"))
    shared.destroy()
    model.calibrate(own, right.astype(bool), np.array(t["loss"].to_pylist(), float).reshape(len(t), len(SCALE)), n, truth)
    return model


def predictions(df: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, cross_entropy and rejected; map-only but for groups of languages."""
    grouped = isinstance(model, Grouped)
    shared = df.sparkSession.sparkContext.broadcast(model)
    k = len(keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema) + "`__lang_pred` string, `__score` double, `__entropy` double, `__rejected` boolean"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in slices(b.column(k)):
                part = b.slice(i, j - i)
                if grouped:
                    h = part.column(k + 3).flatten().to_numpy().reshape(j - i, -1)
                    lang, score, h, gone = shared.value.decide(h, *(part.column(c).to_numpy(zero_copy_only=False) for c in (k + 1, k + 2)))
                else:
                    lang, score, h, gone = shared.value.predict(part.column(k))
                yield pa.RecordBatch.from_arrays([b.column(x).slice(i, j - i) for x in range(k)] + [pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(gone)], names=[*keep, "__lang_pred", "__score", "__entropy", "__rejected"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return (model.scored(rows) if grouped else rows).mapInArrow(work, schema)


def keep_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that are not rejected, with exactly their own columns."""
    model = fit(df.where(~held_out(F.col(f"`{id_col}`"))), id_col, text, lang)
    return predictions(df, model, text, df.columns).where(~F.col("__rejected")).select(*[F.col(f"`{c}`") for c in df.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predictions(docs, model, "text", ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__entropy").alias("cross_entropy"), F.col("__rejected").alias("rejected"))
