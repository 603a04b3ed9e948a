"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every text gives a vector of transformed statistics.  For each (language, source) the
MCD location and scatter are found by concentration steps over *all* rows: a step bins
the squared Mahalanobis distances, sums counts, vectors and products per bin (map-side
combined, so a source with a third of all rows is only a few hundred partial sums per
task), and takes the bins that hold the h nearest rows.  Groups with fewer than
``min_rows`` usable rows take the estimate of their language, then of the whole corpus.

Defined cases: a null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows count as often as they occur; if even
the corpus has fewer than ``min_rows`` usable rows, only the base rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import Words, column, mix, repeated, runs

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: log words, log mean word length, and log(rate + 0.05) of symbols a word, duplicate
#: lines a line, repeated words a word, capitals and punctuation a character.
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5", "f6")
P = len(FEATURES)
#: Least standard deviation of a feature; without it a rate that is 0 in most texts makes the scatter singular.
FLOOR = np.array([0.25, 0.06, 0.25, 0.35, 0.35, 0.15, 0.15])
PER_OCTAVE, LOW, HIGH = 8, -40, 240

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def text_stats(arr: pa.Array) -> dict[str, np.ndarray]:
    """Base statistics and features of each text of a string array."""
    w = Words(arr)
    n = np.diff(w.first)
    lead = (w.buf & 0xC0) != 0x80
    chars = w.per_doc(w.inside & lead)
    symbols = w.per_doc(_SYMBOL[w.buf])
    start, end, doc = w.lines()
    c = np.concatenate([[0], np.cumsum(w.inside)])
    has = c[end] > c[start]
    start, end, doc = start[has], end[has], doc[has]
    key = mix(w.spans(start, end) ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    lines = np.bincount(doc, minlength=w.n_docs)
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=w.n_docs) if len(key) else lines
    dup = lines - distinct
    at, wdoc, h = w.windows(3)
    twice = at[repeated(mix(h ^ (wdoc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))]
    mark = np.zeros(len(w.hash) + 1, bool)
    for k in range(3):
        mark[twice + k] = True
    m = np.concatenate([[0], np.cumsum(mark[: len(w.hash)])])
    rep = m[w.first[1:]] - m[w.first[:-1]]
    upper, punct = w.per_doc(_UPPER[w.buf]), w.per_doc(_PUNCT[w.buf])
    one, ch = np.maximum(n, 1), np.maximum(chars, 1)
    feats = [np.log1p(n), np.log(ch / one), *(np.log(x + 0.05) for x in (symbols / one, dup / np.maximum(lines, 1), rep / one, upper / ch, punct / ch))]
    return dict(zip(STATS, (n, chars, symbols, dup, rep), strict=True)) | dict(zip(FEATURES, feats, strict=True))


def with_stats(df: DataFrame, text: str, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` with statistics and features under ``prefix``; map-only."""
    names = [prefix + x for x in (*STATS, *FEATURES)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema)
    schema += "".join(f", `{prefix}{x}` bigint" for x in STATS) + "".join(f", `{prefix}{x}` double" for x in FEATURES)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = b.column(b.num_columns - 1)
            for i, j in runs(t):
                s = text_stats(t.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(len(keep))] + [pa.array(s[x], pa.int64() if x in STATS else pa.float64()) for x in (*STATS, *FEATURES)], names=[*keep, *names])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def chi2_cdf(x: float, k: int) -> float:
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-15:
        term *= y / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(alpha: float, p: int = P) -> float:
    """Factor that makes the scatter of the central share alpha consistent for normal data."""
    return alpha / max(chi2_cdf(chi2_quantile(alpha, p), p + 2), 1e-9) if alpha < 1 else 1.0


def _model(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    cov = cov + np.diag(np.maximum(FLOOR**2 - np.diag(cov), 0))
    w, v = np.linalg.eigh(cov)
    w = np.maximum(w, (FLOOR.min() / 2) ** 2)
    inv = (v / w) @ v.T
    return mean.tolist(), inv.ravel().tolist(), float(np.log(w).sum())


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


def distance(mu: Column, inv: Column, prefix: str = "") -> Column:
    """Squared Mahalanobis distance as one expression inside codegen."""
    d = [F.col(prefix + f) - mu[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i, j in _pairs():
        total = total + inv[i * P + j] * d[i] * d[j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


_MODEL = "key string, start int, mu array<double>, inv array<double>, logdet double"


def _step(rows: DataFrame, models: DataFrame, share: float | None, cut: float | None = None) -> DataFrame:
    """One concentration step; with ``cut``, the reweighting step instead."""
    bins = F.least(F.greatest(F.floor(F.log2(F.col("d") + 1e-9) * PER_OCTAVE), F.lit(LOW)), F.lit(HIGH))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in _pairs()]]
    d = rows.join(models, "key").withColumn("d", distance(F.col("mu"), F.col("inv")))
    d = d.withColumn("bin", F.when(F.col("d") <= cut, 0).otherwise(1) if cut is not None else bins)
    binned = d.groupBy("key", "start", "bin").agg(*sums)
    factor = consistency(share) if cut is None else consistency(chi2_cdf(cut, P))

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy(float)
        if cut is not None:
            take = (pdf["bin"] == 0).to_numpy()
            if not take.any():
                take[:] = True
        else:
            h = math.ceil(share * n.sum())
            take = np.arange(len(n)) <= np.searchsorted(np.cumsum(n), h)
        m = n[take].sum()
        mean = np.array([pdf[f"s{i}"].to_numpy()[take].sum() for i in range(P)]) / m
        cov = np.zeros((P, P))
        for i, j in _pairs():
            cov[i, j] = cov[j, i] = pdf[f"q{i}_{j}"].to_numpy()[take].sum() / m - mean[i] * mean[j]
        mu, inv, logdet = _model(mean, cov * factor)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "start": [pdf["start"].iloc[0]], "mu": [mu], "inv": [inv], "logdet": [logdet]})

    return common.saved(binned.groupBy("key", "start").applyInPandas(update, _MODEL))


def _key(level: str) -> Column:
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    parts = {"s": [lang, source], "l": [lang], "g": []}[level]
    return F.to_json(F.struct(F.lit(level).alias("v"), *[x.alias(f"k{i}") for i, x in enumerate(parts)]))


def fit(stats: DataFrame, min_rows: int = 200, share: float = 0.75, steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fits the MCD over saved statistics (lang, source and features).

    Returns the models by key, and for each (lang, source) the key whose model it uses.
    """
    ok = stats.where(~base_failed()).select("lang", "source", *FEATURES)
    counts = common.saved(ok.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    groups = stats.select("lang", "source").distinct()
    g = groups.alias("g")
    uses = (
        g.join(counts.alias("c"), F.col("g.lang").eqNullSafe(F.col("c.lang")) & F.col("g.source").eqNullSafe(F.col("c.source")), "left")
        .join(by_lang.alias("b"), F.col("g.lang").eqNullSafe(F.col("b.lang")), "left")
        .withColumn("n_all", F.lit(total.first()[0]))
        .select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), "n", "n_lang", "n_all")
        .withColumn("use", F.when(F.col("n") >= min_rows, _key("s")).when(F.col("n_lang") >= min_rows, _key("l")).when(F.col("n_all") >= min_rows, _key("g")))
        .select("lang", "source", "use")
    )
    uses = common.saved(uses)
    needed = uses.where("use is not null").select(F.col("use").alias("key")).distinct()
    rows = ok.select(F.explode(F.array(_key("s"), _key("l"), _key("g"))).alias("key"), *FEATURES).join(needed, "key", "left_semi")
    quart = rows.groupBy("key").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f) for f in FEATURES], *[F.avg(f).alias(f"a{i}") for i, f in enumerate(FEATURES)], *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(FEATURES)])

    def begin(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                q = np.array([getattr(r, f) for f in FEATURES])
                out.append((r.key, 0, *_model(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))))
                out.append((r.key, 1, *_model(np.array([getattr(r, f"a{i}") for i in range(P)]), np.diag([getattr(r, f"v{i}") for i in range(P)]))))
            yield pd.DataFrame(out, columns=["key", "start", "mu", "inv", "logdet"])

    models = common.saved(quart.mapInPandas(begin, _MODEL))
    for _ in range(steps):
        models = _step(rows, models, share)
    best = models.groupBy("key").agg(F.min_by(F.struct("start", "mu", "inv", "logdet"), F.struct("logdet", "start")).alias("m")).select("key", "m.*")
    return _step(rows, best, None, cut=chi2_quantile(0.975, P)), uses


def scored(stats: DataFrame, models: DataFrame, uses: DataFrame, prefix: str = "", lang: str = "lang", source: str = "source", cut: float | None = None) -> DataFrame:
    """Adds <prefix>base_failed, <prefix>distance and <prefix>kept; rows and columns stay."""
    cut = chi2_quantile(1 - 1e-12, P) if cut is None else cut
    m = uses.join(models.withColumnRenamed("key", "use"), "use", "left").select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("mu").alias("__mu"), F.col("inv").alias("__inv"))
    j = stats.join(m, F.col(f"`{lang}`").cast("string").eqNullSafe(F.col("__l")) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__s")), "left")
    j = j.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "distance", F.when(F.col("__mu").isNotNull(), distance(F.col("__mu"), F.col("__inv"), prefix)))
    return j.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.coalesce(F.col(prefix + "distance") <= cut, F.lit(True))).drop("__l", "__s", "__mu", "__inv")


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """One row per input row: id, statistics, base_failed, distance and kept."""
    stats = common.saved(with_stats(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text")), "text", ["id", "lang", "source"]))
    cut = options.pop("cut", None)
    models, uses = fit(stats, **options)
    return scored(stats, models, uses, cut=cut).select(F.col("id").alias(id_col), *STATS, "base_failed", "distance", "kept")


def keep_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The input rows that pass, with exactly their own columns."""
    pre = "__quality_"
    cut = options.pop("cut", None)
    own = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    stats = common.saved(with_stats(own, "text", ["lang", "source"]))
    models, uses = fit(stats, **options)
    # the statistics are computed once more beside the rows, which is cheaper than moving texts to them
    return scored(with_stats(df, text, df.columns, pre), models, uses, pre, lang, source, cut).where(F.col(pre + "kept")).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))
